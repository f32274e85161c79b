"""Readers, sinks and streams on literal files."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from postmill.operators.metrics import clean_predictions
from postmill.sources import readers, sinks
from postmill.streaming import live

MAIL = b"""From: a@x.test
Subject: =?utf-8?q?Caf=C3=A9_offer?=
Date: Tue, 5 Mar 2019 10:00:00 +0000
MIME-Version: 1.0
Content-Type: multipart/alternative; boundary=B

--B
Content-Type: text/plain; charset=no-such

Hello
> quoted
there
--B
Content-Type: text/html

<p>Hi</p>
--B
Content-Type: text/plain
Content-Disposition: attachment; filename=a.txt

secret
--B--
"""


def test_tables_of_text(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('ham\tSay "hi"\nspam\tWin, now\n')
    assert [(r.label, r.text, r.year) for r in readers.read_tsv(spark, str(tmp_path / "a.tsv")).collect()] == [("ham", 'Say "hi"', 2011), ("spam", "Win, now", 2011)]
    (tmp_path / "b.csv").write_bytes('LABEL,TEXT\nSmishing,"Pay £5, now"\n'.encode("latin-1"))
    assert [(r.label, r.text) for r in readers.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [("smishing", "Pay £5, now")]
    (tmp_path / "c.csv").write_bytes("LABEL,TEXT\nham,€5\n".encode("cp1252"))
    assert readers.read_csv(spark, str(tmp_path / "c.csv"), encoding="windows-1252").first().text == "€5"


def test_ragged(spark, tmp_path):
    lines = ["SMS,IN,1,1,July 2012,,HAM,\"Hi, you\",,", "SMS,out,1,1,no year,0,spam,Win, now,,,spam", "SMS,IN,1,1,2012,,MAYBE,x", "cut,line", ""]
    (tmp_path / "u.csv").write_text("\n".join(lines))
    got = [(r.label, r.direction, r.year, r.text) for r in readers.read_ragged(spark, str(tmp_path)).collect()]
    assert got == [("ham", "IN", 2012, "Hi, you"), ("spam", "out", 2014, "Win, now")]


def test_mail_parquet(spark, tmp_path):
    rows = [("a , b", "it ' s me", 1, "2001-05-06"), (None, "x", 0, "not a date")]
    spark.createDataFrame(rows, "subject string, message string, label int, date string").write.parquet(str(tmp_path / "m"))
    got = {(r.label, r.text, r.text_as_packaged, r.year) for r in readers.read_mail_parquet(spark, str(tmp_path / "m")).collect()}
    assert got == {("spam", "Subject: a, b\nit's me", "Subject: a , b\nit ' s me", 2001), ("ham", "Subject: \nx", "Subject: \nx", 2004)}


def test_folders_and_mailboxes(spark, tmp_path):
    (tmp_path / "easy").mkdir()
    (tmp_path / "easy" / "1").write_bytes(MAIL)
    (tmp_path / "easy" / "cmds").write_bytes(b"mv a b")
    got = readers.read_mail_folders(spark, {str(tmp_path / "easy"): "ham"}).collect()
    assert [(r.label, r.text, r.year) for r in got] == [("ham", "Subject: Café offer\nHello\nthere", 2019)]
    box = b"From a@x Tue\nSubject: one\n\nfirst\n>From here\n\nFrom b@x Wed\nSubject: two\n\nsecond\n"
    (tmp_path / "phishing-2017").write_bytes(box)
    got = readers.read_mbox(spark, str(tmp_path / "phishing-2017")).orderBy("text").collect()
    assert [(r.text, r.year, r.file) for r in got] == [("Subject: one\nfirst\nFrom here", 2017, "phishing-2017"), ("Subject: two\nsecond", 2017, "phishing-2017")]


def test_bytes_of_mailboxes_stay_whole(spark, tmp_path):
    (tmp_path / "box-2001").write_bytes(b"From a@x Tue\nSubject: one\n\nfirst\n\nFrom b@x Wed\nSubject: two\nContent-Type: text/plain; charset=windows-1252\n\ncaf\xe9 \x80 5\n")
    got = readers.read_mbox(spark, str(tmp_path / "box-2001")).orderBy("text").collect()
    assert [r.text for r in got] == ["Subject: one\nfirst", "Subject: two\ncafé € 5"]


def test_json_and_catalogue(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 3}\n{"x": 4}\n')
    assert [r.x for r in readers.read_json(spark, str(tmp_path / "a.json"), "x int").collect()] == [1, 2]
    assert [r.x for r in readers.read_json(spark, str(tmp_path / "b.jsonl"), "x int").collect()] == [3, 4]
    (tmp_path / "sms_archive").mkdir()
    (tmp_path / "sms_archive" / "a.tsv").write_text("ham\thello\n")
    got = readers.read_catalogue(spark, str(tmp_path), "sms_archive").first()
    assert (got.text, got.source, got.domain) == ("hello", "sms_archive", "sms")


def test_tar(spark, tmp_path):
    import tarfile

    (tmp_path / "a.txt").write_text("hello")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        archive.add(tmp_path / "a.txt", "d/a.txt")
    assert [(r.member, bytes(r.content)) for r in readers.read_archive(spark, str(tmp_path / "a.tar.gz")).collect()] == [("d/a.txt", b"hello")]


def test_zip_and_digest(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/a.txt", "hello")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    assert [(r.member, bytes(r.content)) for r in readers.read_archive(spark, str(tmp_path / "a.zip")).collect()] == [("d/a.txt", b"hello")]
    assert len(sinks.bundle_digest(spark.read.format("binaryFile").load(str(tmp_path))).first().digest) == 12


def test_cache_newest_wins_and_appends(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "seq bigint, model string, variant string, id string, label string, secs double"
    sinks.append_cache(spark.createDataFrame([(1, "m", "z", "a", "spam", 0.1), (2, "m", "z", "b", "legit", None)], schema), path)
    sinks.append_cache(spark.createDataFrame([(3, "m", "z", "a", "legit", 0.2)], schema), path)
    assert {(r.id, r.label, r.seq) for r in readers.read_cache(spark, path).collect()} == {("a", "legit", 3), ("b", "legit", 2)}


def test_reports_and_wide_predictions(spark, tmp_path):
    rows = [("r1", 1, 0.5, 0.3, 0.2), ("r2", 1, 0.1, 0.2, 0.7)]
    df = spark.createDataFrame(rows, "run string, msg_id bigint, p_legit double, p_spam double, p_phishing double")
    wide = sinks.wide_predictions(df, ["r1", "r2"], ["msg_id"]).first()
    assert (wide.r1__p_legit, wide.r2__p_phishing) == (0.5, 0.7)
    table = spark.createDataFrame([("sms", "f1", 0.5), ("email", "f1", 0.75)], "scope string, metric string, value double")
    assert json.loads(sinks.report_json(table, "scope", "metric", "value").first().report) == {"email": {"f1": 0.75}, "sms": {"f1": 0.5}}


def test_predictions_scored_last(spark):
    rows = [("r", 1, 0.9, 0.05, 0.05, "2026-01-01"), ("r", 1, 0.1, 0.8, 0.1, "2026-01-02"), ("r", 1, 0.1, 0.8, 0.1, "2026-01-02"), (None, 2, 0.1, 0.8, 0.1, None), ("r", 3, None, 0.8, 0.1, None)]
    df = spark.createDataFrame(rows, "run string, msg_id bigint, p_legit double, p_spam double, p_phishing double, scored_at string").withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    assert [(r.msg_id, r.p_legit) for r in clean_predictions(df).collect()] == [(1, 0.1)]


def test_streams(spark, tmp_path):
    rows = [(1, "Hello there", "sms", "2024-01-01 10:00:00"), (2, "hello THERE!", "sms", "2024-01-01 10:05:00"), (3, "Other text", "sms", "2024-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "msg_id bigint, text string, domain string, sent_at string").withColumn("sent_at", F.col("sent_at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.read_messages(spark, str(tmp_path / "in"), df.schema)
    live.run_available(live.prepared(live.first_copies(stream)), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and all(r.prepared.startswith("[sms] ") for r in got.collect())
    live.run_available(live.prepared(live.first_copies(stream)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_corpus_is_written_by_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "sms"), (2, "test", "email")], "msg_id bigint, split string, domain string")
    sinks.write_corpus(df, str(tmp_path / "c"))
    assert [r.msg_id for r in spark.read.parquet(str(tmp_path / "c")).filter("split = 'test'").collect()] == [2]
