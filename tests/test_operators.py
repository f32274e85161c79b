"""Components, dedup, splits, metrics, models on small tables."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators import dedup, explain, features as X, metrics as E, models as M, split
from postmill.operators.components import connected_components
from postmill.service import check_request, classify


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "path", "star", "loops"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)],
        "path": [(i, i + 1) for i in range(200)],
        "star": [(1000, i) for i in range(200)] + [(1000, 2000)],
        "loops": [(1, 1), (2, 3), (3, 2), (3, 3)],
    }[shape]
    rows = edges + [(None, 1), (2, None)]
    got = connected_components(spark.createDataFrame(rows, "src bigint, dst bigint"))
    assert {r.node: r.component for r in got.collect()} == union_find(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_exact_dedup_keeps_the_most_severe_then_earliest(spark):
    rows = [(1, "Hello there!", "legit", "sms", 2010), (2, "hello THERE", "phishing", "sms", 2012), (3, "hello, there", "phishing", "sms", 2011), (4, "hello there", "legit", "email", 2010)]
    df = dedup.with_key(spark.createDataFrame(rows, "msg_id bigint, text string, label string, domain string, year int"))
    assert {r.msg_id for r in dedup.exact_dedup(df).collect()} == {3, 4}
    audit = {r.domain: (r.n_duplicates, r.n_conflicts) for r in dedup.duplicate_audit(df).collect()}
    assert audit == {"sms": (2, 1), "email": (0, 0)}


def test_near_duplicate_groups(spark):
    rows = [(1, "sms", "Your parcel 123 is held, pay the fee at once"), (2, "sms", "Your parcel 987 is held, pay the fee at once"), (3, "sms", "See you at the pub around eight"), (4, "email", "Your parcel 123 is held, pay the fee at once")]
    df = spark.createDataFrame(rows, "msg_id bigint, domain string, text string")
    for verify in (True, False):
        assert {r.id: r.group for r in dedup.near_duplicate_groups(df, verify=verify).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_registered_campaigns_link_every_shared_band(spark, monkeypatch):
    from postmill.plans import campaigns

    rng = random.Random(4)
    words = ["parcel", "held", "fee", "river", "garden", "ticket", "window", "branch", "copper", "lantern", "market", "saddle"]
    rows = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(24)]
        for _ in range(5):
            edited = list(base)
            for at in rng.sample(range(24), 4):
                edited[at] = rng.choice(words)
            rows.append((len(rows) + 1, "sms", " ".join(edited)))
    monkeypatch.setattr(campaigns, "corpus", lambda spark, sf_dir: spark.createDataFrame(rows, "msg_id bigint, domain string, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows)], names=["id", "domain", "text"])
    bands = {}
    for b in dedup._bands(iter([batch])):
        for r in b.to_pylist():
            bands.setdefault(r["band"], []).append(r["id"])
    expected = {r[0]: r[0] for r in rows} | union_find([(m[0], x) for m in bands.values() for x in m[1:]])
    assert {r.msg_id: r.campaign for r in campaigns.minhash_groups(spark, "").collect()} == expected


def test_no_group_in_two_splits(spark):
    rows = [(i, i % 50, "sms_archive", "spam" if i % 3 else "legit", 2011) for i in range(500)]
    df = split.campaign_split(spark.createDataFrame(rows, "msg_id bigint, `group` bigint, source string, label string, year int"))
    assert df.groupBy("group").agg(F.countDistinct("new_split").alias("n")).filter("n > 1").count() == 0


def test_group_of_unknown_kind_is_test(spark):
    df = spark.createDataFrame([(1, 5, "a", "spam_unlabelled", 2011)], "msg_id bigint, `group` bigint, source string, label string, year int")
    assert split.campaign_split(df).first().new_split == "test"


def test_weighted_draw_follows_the_weights(spark):
    df = spark.createDataFrame([(i, 9.0 if i < 10 else 1.0) for i in range(100)], "msg_id bigint, w double")
    got = split.weighted_draw(df, F.col("w"), 3000, "1").collect()
    assert len(got) == 3000 and 0.42 < sum(r.id < 10 for r in got) / 3000 < 0.58


@pytest.mark.parametrize("p, label", [((0.41, 0.30, 0.29), 1), ((0.90, 0.05, 0.05), 0), ((0.20, 0.10, 0.70), 2), ((0.5, 0.25, 0.25), 1)])
def test_decide(spark, p, label):
    assert spark.createDataFrame([p], "a double, b double, c double").select(M.decide(F.col("a"), F.col("b"), F.col("c")).alias("d")).first().d == label


def scored(spark, rows):
    return spark.createDataFrame([("r", y, p, s) for y, p, s in rows], "run string, y int, pred int, p_legit double")


def test_metrics_by_hand(spark):
    df = scored(spark, [(0, 0, 0.9), (0, 1, 0.4), (1, 1, 0.2), (2, 0, 0.6), (2, 2, 0.1)])
    assert E.confusion(df, ["run"]).agg(F.sum("n")).first()[0] == 5 and E.confusion(df, ["run"]).count() == 9
    rates = E.scam_rates(df, ["run"]).first()
    assert (rates.accuracy, rates.scam_recall, rates.legit_fpr) == (0.6, 2 / 3, 0.5)
    assert E.macro_f1(df, ["run"]).first().macro_f1 == pytest.approx((0.5 + 2 / 3 + 2 / 3) / 3)
    # by score 1 - p: .9 hit, .8 hit, .6 miss, .4 hit, .1 miss
    assert E.average_precision(df, ["run"]).first().average_precision == pytest.approx((1 + 1 + 3 / 4) / 3)
    interval = E.bootstrap_interval(df, ["run"], draws=200).first()
    assert 0 <= interval.low < interval.high <= 1


def test_present_classes_only(spark):
    df = scored(spark, [(0, 0, 0.9), (1, 1, 0.2)])
    assert E.macro_f1(df, ["run"]).first().macro_f1 == 1.0
    assert E.macro_f1(df, ["run"], present_only=False).first().macro_f1 == pytest.approx(2 / 3)


def test_calibration_error_puts_1_in_the_last_bin(spark):
    assert E.calibration_error(scored(spark, [(1, 1, 0.0), (0, 0, 1.0)]), ["run"]).first().ece == 0


def test_refusals_are_wrong(spark):
    rows = [("m", "legit", "legit"), ("m", "spam", "phishing"), ("m", "phishing", "phishing"), ("m", "legit", "error")]
    out = E.refusal_metrics(spark.createDataFrame(rows, "model string, truth string, answer string"), ["model"]).first()
    assert (out.accuracy, out.errors, out.scam_recall) == (0.5, 1, 1.0)


TRAIN = [(1, "win a free prize now", "spam"), (2, "free prize inside", "spam"), (3, "your account is locked", "phishing"), (4, "verify your account", "phishing"), (5, "see you at lunch", "legit"), (6, "lunch at noon", "legit")]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(TRAIN, "msg_id bigint, text string, label string")
    presence = df.select(F.col("msg_id").alias("id"), F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    return M.fit_bernoulli_nb(presence, df.select(F.col("msg_id").alias("id"), "label"), presence.select("term").distinct()).cache()


def test_classify_and_evidence(spark, model):
    df = spark.createDataFrame([(1, "free prize now"), (2, "lunch at noon"), (3, ""), (4, "verify account account")], "msg_id bigint, text string")
    out = {r.id: r for r in classify(df, model).collect()}
    assert (out[1].label, out[2].label, out[4].label) == ("spam", "legit", "phishing")
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-3 for r in out.values())
    assert {e.word for e in out[1].evidence} <= {"free", "prize", "now"} and out[1].evidence
    assert "account" not in {e.word for e in out[4].evidence}  # said twice: leaving one out changes nothing
    assert out[3].evidence is None
    texts = {r.msg_id: r.text for r in df.collect()}
    assert all(texts[i][e.start : e.end] == e.word for i, r in out.items() for e in r.evidence or ())


def test_evidence_spans_of_a_text_that_begins_with_blanks(spark, model):
    df = spark.createDataFrame([(1, " \u00a0free\n prize  now")], "msg_id bigint, text string")
    found = {e.word: (e.start, e.end) for e in classify(df, model).first().evidence}
    assert found and all(df.first().text[a:b] == w for w, (a, b) in found.items())


def test_health_and_card(spark):
    import json

    from postmill import service

    assert service.health()["status"] == "ok"
    card = json.loads(service.model_card(spark.createDataFrame([("sms", 0.9)], "domain string, macro_f1 double"), "nb"))
    assert card["model"] == "nb" and card["metrics"] == [{"domain": "sms", "macro_f1": 0.9}]


def test_occlusion_equals_scoring_again(spark, model):
    text = "win lunch at the prize office"
    words = text.split()
    rows = [(0, text)] + [(k + 1, " ".join(words[:k] + words[k + 1 :])) for k in range(len(words))]
    df = spark.createDataFrame(rows, "msg_id bigint, text string")
    presence = df.select(F.col("msg_id").alias("id"), F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    scores = M.nb_scores(presence, df.select(F.col("msg_id").alias("id")), model)
    odds = {r.id: r.o for r in scores.select("id", M.log_odds(1 - F.col("p_legit")).alias("o")).collect()}
    got = {r.position: r.impact for r in explain.occlusion(df.filter("msg_id = 0"), model, scores).collect()}
    want = {k: round(odds[0] - odds[k + 1], 3) for k in range(len(words))}
    assert got == pytest.approx({k: v for k, v in want.items() if abs(v) >= explain.LEAST_IMPACT}, abs=2e-3)


def test_requests():
    assert check_request(["hi"], "sms") == ["hi"]
    for texts, kind in (([""], "sms"), (["x" * 6001], "sms"), (["hi"], "fax"), (["a", "b"], "sms")):
        with pytest.raises(ValueError):
            check_request(texts, kind)
    assert len(check_request(["x" * 7000], "sms", batch=True)[0]) == 6000


class Client:
    def __init__(self, budget):
        self.budget = budget

    def __call__(self, text, system):
        if self.budget == 0:
            raise M.QuotaExhausted
        self.budget -= 1
        return text


def test_remote_scorer_fails_over_and_ends():
    label = M.remote_scorer(lambda key: Client(2), ["a", "b"])
    assert [label(x, "") for x in ("spam", "spam", "legit", "maybe")] == ["spam", "spam", "legit", "error"]
    with pytest.raises(M.QuotaExhausted):
        label("spam", "")


def test_score_with_any_model(spark):
    df = spark.createDataFrame([(i, "x" * i, "sms") for i in range(1, 9)], "msg_id bigint, text string, domain string")
    out = M.score_with(df, lambda: lambda texts, domains: [[1 / len(t), 0.0, 1 - 1 / len(t)] for t in texts], batch=3)
    assert {r.id: round(r.p_legit, 4) for r in out.collect()} == {i: round(1 / i, 4) for i in range(1, 9)}


def test_char_ngrams_stay_inside_words(spark):
    got = spark.createDataFrame([("Ab c",)], "t string").select(X.char_ngrams(F.col("t"), 2, 3).alias("g")).first().g
    assert sorted(got) == sorted([" a", "ab", "b ", " ab", "ab ", " c", "c ", " c "])


def test_nearest_equals_brute_force(spark, monkeypatch):
    import numpy as np

    from postmill.operators import neighbours

    rng = np.random.default_rng(1)
    data = {i: rng.normal(size=8).tolist() for i in range(200)}
    data[7] = [0.0] * 8
    rows = spark.createDataFrame([*data.items(), (999, None)], "vec_id bigint, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in data.items() if i != 7}
    want = {(q, i) for q in range(0, 200, 20) for i in sorted((i for i in unit if i != q), key=lambda i: (-unit[q] @ unit[i], i))[:4]}
    for size in (512, 3):
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", size)
        monkeypatch.setattr(neighbours, "ROW_BLOCK", 32 * size)
        got = neighbours.nearest(rows.filter("vec_id % 20 = 0"), rows, 4)
        assert {(r.query_id, r.id) for r in got.collect()} == want


def test_char_counts_are_the_char_ngrams(spark):
    rows = [(1, "Ab c ab\u00a0É"), (2, ""), (3, None), (4, "x")]
    df = spark.createDataFrame(rows, "msg_id bigint, text string")
    got = {(r.id, r.term): r.tf for r in X.char_counts(df).collect()}
    want = {(r.id, r.term): r.tf for r in X.term_counts(df.filter("text is not null"), X.char_ngrams(F.col("text"), 2, 5)).collect()}
    assert got == want and got


def test_char_tfidf_writes_less_than_its_ngrams(spark, tmp_path):
    """Repeated and missing ids as SQL has them; tables cut on the way stay near the size of the texts, not of their n-grams (hundreds a row)."""
    import os

    import duckdb

    from postmill import runtime
    from postmill.plans import models, registry

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    rows = [(k, " ".join(rng.choices(words, k=60))) for k in range(1500)] + [(3, "Once more \u00c9a"), (7, None), (8, "once more"), (None, "once more"), (None, "twice"), (5000, ""), (5001, "\u2003q"), (5002, None)]
    spark.createDataFrame(rows, "msg_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/corpus.parquet")
    before = set(runtime._written)
    got = {r.msg_id: r[1:] for r in models.char_tfidf(spark, str(tmp_path)).collect()}
    made = [os.path.join(d, f) for path in runtime._written - before for d, _, names in os.walk(path.removeprefix("file://")) for f in names]
    assert sum(map(os.path.getsize, made)) < 2 * sum(len(t or "") for _, t in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW corpus AS SELECT * FROM '{tmp_path}/corpus.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(registry.oracle_sql()["char_tfidf"]).fetchall()}
    assert got.keys() == want.keys() and len(want) == 1500
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-4)


def test_char_tfidf_in_chunks(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, " ".join(rng.choice(["win", "a", "parcel", "\u00e9t\u00e9", str(rng.randrange(300))]) for _ in range(rng.randrange(1, 30)))) for k in range(400)], "msg_id bigint, text string").repartition(3)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    counts = X.char_counts(df)
    weights = X.tfidf(counts, X.vocabulary(counts, min_df=3), n, sublinear=True)
    want = {r.id: r[1:] for r in weights.groupBy("id").agg(F.count("w"), F.max("w"), F.sum("w")).collect()}
    for held in (1, 50, 1 << 19):
        got = {r.id: r[1:] for r in X.char_tfidf_lengths(df, n, 3, held=held).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k])


def test_quantiles_equal_percentile(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random(), 0.5, -3.0, 7.25])) for g in ("a", "b", None) for _ in range(rng.choice([1, 2, 50, 301]))] + [("c", None), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.125, 0.5, 0.9, 1.0]
    got = {r.g: list(r.edges) for r in E.quantiles(df, ["g"], "v", shares).collect()}
    want = {r.g: list(r.p) for r in df.filter("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g])


def test_text_vectors_hold_two_unit_halves(spark):
    import numpy as np

    df = spark.createDataFrame([(k, t) for k, t, _ in TRAIN] + [(9, "unseen wörds")], "msg_id bigint, text string")
    out = {r.id: r.features for r in M.text_vectors(df, df.filter("msg_id < 9").select(F.col("msg_id").alias("id"))).collect()}
    assert len(out) == 7 and len({v.size for v in out.values()}) == 1
    assert np.linalg.norm(out[1].toArray()) == pytest.approx(2**0.5)
    labels = spark.createDataFrame([(k, {"legit": 0, "spam": 1, "phishing": 2}[x]) for k, _, x in TRAIN], "id bigint, y int")
    vectors = M.text_vectors(df, df.filter("msg_id < 9").select(F.col("msg_id").alias("id"))).join(labels, "id")
    scored = M.logistic_regression(vectors, vectors).collect()
    assert all(r.prediction == r.y for r in scored)


def test_text_vectors_write_vectors_alone(spark):
    """Whole vectors are made in one pass: besides them only the counts of terms are written, not the terms of every row; weights as the long tables have them."""
    import os

    import numpy as np

    from postmill import runtime

    rng = random.Random(3)
    df = spark.createDataFrame([(k, " ".join(rng.choices(["Win", "parcel", "\u00e9t\u00e9", "pay", "x", "the fee", "7"], k=rng.randrange(12)))) for k in range(300)] + [(300, None)], "msg_id bigint, text string")
    train = df.filter("msg_id % 3 > 0").select(F.col("msg_id").alias("id"))
    before = set(runtime._written)
    out = {r.id: r.features for r in M.text_vectors(df, train, words=20, grams=60).collect()}
    tables = [spark.read.parquet(path) for path in runtime._written - before]
    assert sum(t.count() for t in tables) == 301 == len(out)
    n, want = train.agg(F.count(F.lit(1)).alias("n")), {}
    tokens = df.select("msg_id", F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)).alias("tokens"))
    first = 0
    for counts, least, most in ((X.term_counts(tokens, X.word_ngrams(F.col("tokens"), 1, 2)), 2, 20), (X.char_counts(df), 3, 60)):
        vocab = X.vocabulary(counts.join(train, "id"), least, most)
        place = {t: first + k for k, t in enumerate(sorted(r.term for r in vocab.collect()))}
        first += len(place)
        want |= {(r.id, place[r.term]): r.w for r in X.tfidf(counts, vocab, n, sublinear=True).collect()}
    got = {(k, int(i)): w for k, v in out.items() for i, w in zip(v.indices, v.values)}
    assert got.keys() == want.keys() and all(v.size == first for v in out.values())
    assert np.allclose([got[k] for k in want], list(want.values()))


def test_stratified_folds_hold_their_share(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(900), rng.choice(["sms", "email"]), rng.choice(["legit", "spam"])) for _ in range(6000)] + [(None, "sms", "spam")]
    out = split.stratified_folds(spark.createDataFrame(rows, "`group` bigint, domain string, label string")).toPandas()
    assert len(out) == len({r[0] for r in rows}) - 1 and set(out.fold) <= set(range(7))
    sizes = out.groupby(["stratum", "fold"]).group.count().unstack(fill_value=0)
    assert (sizes.max(axis=1) < 2.2 * sizes.mean(axis=1)).all()


def test_labels_in_answers():
    answers = ['{"label": "spam"}', "Phishing ", '"legit"', "[1]", "", '{"label": 3}', "maybe"]
    assert [M.parse_label(a) for a in answers] == ["spam", "phishing", "legit", "error", "error", "error", "error"]


def test_calls_are_spaced():
    waits = []
    label = M.remote_scorer(lambda key: lambda text, system: text, ["a"], wait=waits.append, pause=5.0)
    assert [label(x, "") for x in ("spam", "legit")] == ["spam", "legit"] and len(waits) == 1 and 4 < waits[0] <= 5


def test_answers_resume(spark):
    messages = spark.createDataFrame([("sms-1", "win"), ("sms-2", "hi"), ("sms-3", None)], "id string, text string")
    done = spark.createDataFrame([("m", "v", "sms-1", "spam"), ("m", "v", "sms-2", "error"), ("m", "w", "sms-3", "spam")], "model string, variant string, id string, label string")
    out = M.answer_pending(messages, done, lambda: lambda text, system: "legit", "m", "v")
    assert {(r.id, r.label) for r in out.collect()} == {("sms-2", "legit"), ("sms-3", "legit")}
    assert M.answer_pending(messages, done.unionByName(out.drop("secs")), lambda: lambda text, system: "legit", "m", "v").count() == 0


def test_published_chain_learns(spark):
    df = spark.createDataFrame(TRAIN, "msg_id bigint, text string, label string")
    counts = X.term_counts(df, T.tokenize(F.col("text")))
    model = M.fit_nb(counts, df.select(F.col("msg_id").alias("id"), "label"), vocabulary=20, selected=10)
    assert model.select("term").distinct().count() == 10
    scores = {r.id: r for r in M.nb_scores(counts, df.select(F.col("msg_id").alias("id")), model).collect()}
    assert scores[1].p_spam > scores[1].p_legit and scores[5].p_legit > scores[5].p_spam


def test_scratch_deletes_what_was_cut_inside(spark):
    import os

    from postmill import runtime

    with runtime.scratch(spark):
        kept = runtime.cut(spark.range(5))
        path = kept._postmill_path.removeprefix("file://")
        assert kept.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
