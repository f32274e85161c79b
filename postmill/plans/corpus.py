"""Queries over the corpus: labels, filters, exact duplicates, relabelling, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill.functions import text as T
from postmill.operators import dedup, split
from postmill.plans.registry import query
from postmill.runtime import table
from postmill.schema import LABELS, SEVERITY, label_index, lookup, message_id, unify_label, union_messages

# Shared pieces of oracle SQL. REPAIRED: text of Latin-1 that reads as UTF-8 byte for byte.
BYTES = "from_hex(array_to_string(list_transform(string_split(text, ''), lambda c: printf('%02X', unicode(c))), ''))"
REPAIRED = f"(CASE WHEN regexp_full_match(text, '[\\x{{00}}-\\x{{FF}}]*', 's') AND regexp_matches(text, '[\\x{{80}}-\\x{{FF}}]') THEN coalesce(TRY(decode({BYTES})), text) ELSE text END)"


def _replaced(c: str, pairs) -> str:
    for a, b in pairs:
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


ENTITIES_READ = f"(CASE WHEN contains({REPAIRED}, '<') THEN {REPAIRED} ELSE {_replaced(REPAIRED, T.NAMED_ENTITIES)} END)"
PLAIN = _replaced(f"translate({ENTITIES_READ}, '{T.WIDE}', '{T.NARROW.replace(chr(39), chr(39) * 2)}')", T.LIGATURES)
KEY = f"regexp_replace(lower({PLAIN}), '[^a-z0-9]', '', 'g')"
LATIN = "CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 1.0 ELSE length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::double / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) END"
SEV = "CASE label WHEN 'legit' THEN 0 WHEN 'spam' THEN 1 WHEN 'spam_unlabelled' THEN 1 WHEN 'phishing' THEN 2 ELSE -1 END"
CLEAN = "lower(trim(split))"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus")


@query("SELECT msg_id, CASE lower(trim(label)) WHEN 'ham' THEN 'legit' WHEN 'hard_ham' THEN 'legit' WHEN 'smishing' THEN 'phishing' WHEN 'legit' THEN 'legit' WHEN 'spam' THEN 'spam' WHEN 'phishing' THEN 'phishing' WHEN 'spam_unlabelled' THEN 'spam_unlabelled' END AS unified FROM corpus")
def label_unify(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", unify_label(F.col("label")).alias("unified"))


@query("SELECT label, domain, count(*) AS n_rows FROM corpus GROUP BY label, domain")
def label_counts(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("label", "domain").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT source, count(*) FILTER (label = 'legit') AS legit, count(*) FILTER (label = 'spam') AS spam, count(*) FILTER (label = 'phishing') AS phishing, count(*) AS n_rows FROM corpus GROUP BY source")
def source_label_pivot(spark, sf_dir):
    wide = corpus(spark, sf_dir).groupBy("source").pivot("label", list(LABELS)).agg(F.count(F.lit(1))).na.fill(0, list(LABELS))
    total = corpus(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    return wide.join(total, wide["source"].eqNullSafe(total["source"])).select(wide["source"], *LABELS, "n_rows")


@query(f"SELECT {CLEAN} AS split, domain, label, count(*) AS n_rows FROM corpus GROUP BY ALL")
def corpus_size_report(spark, sf_dir):
    return split.size_report(corpus(spark, sf_dir).withColumn("split", F.lower(F.trim("split"))))


@query(f"SELECT source, count(*) FILTER (s < 0.8) AS dropped, count(*) AS n_rows, round(avg(s), 6) AS mean_share FROM (SELECT source, {LATIN} AS s FROM corpus) GROUP BY source")
def latin_share_filter(spark, sf_dir):
    shares = corpus(spark, sf_dir).select("source", T.latin_share(F.col("text")).alias("s"))
    return shares.groupBy("source").agg(F.count(F.when(F.col("s") < dedup.LEAST_LATIN, 1)).alias("dropped"), F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("s"), 6).alias("mean_share"))


@query(f"SELECT msg_id, {KEY} AS key FROM corpus")
def dedup_key(spark, sf_dir):
    return dedup.with_key(corpus(spark, sf_dir)).select("msg_id", "key")


_DEDUP = f"SELECT msg_id, domain, label, year FROM (SELECT *, row_number() OVER (PARTITION BY domain, key ORDER BY sev DESC, coalesce(year, 9999), msg_id) AS r FROM (SELECT *, {KEY} AS key, {SEV} AS sev, {LATIN} AS share FROM corpus) WHERE share >= 0.8 AND length(key) >= 8) WHERE r = 1"


@query(_DEDUP)
def exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(dedup.usable(corpus(spark, sf_dir))).select("msg_id", "domain", "label", "year")


@query(f"SELECT domain, label, count(*) AS n_rows, min(year) AS first_year FROM ({_DEDUP}) GROUP BY domain, label")
def exact_dedup_counts(spark, sf_dir):
    return exact_dedup(spark, sf_dir).groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.min("year").alias("first_year"))


@query(f"SELECT domain, sum(n)::bigint AS n_rows, count(*) AS n_keys, sum(n - 1)::bigint AS n_duplicates, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END)::bigint AS n_conflicts FROM (SELECT domain, {KEY} AS key, count(*) AS n, count(DISTINCT label) AS k FROM corpus GROUP BY 1, 2) GROUP BY domain")
def dup_conflict_audit(spark, sf_dir):
    return dedup.duplicate_audit(dedup.with_key(corpus(spark, sf_dir)))


_REL = f"WITH k AS (SELECT *, {KEY} AS key FROM corpus), a AS (SELECT * FROM k WHERE source = 'sms_archive'), b AS (SELECT * FROM k WHERE source = 'sms_relabel') "


@query(_REL + "SELECT msg_id, label, source FROM (SELECT msg_id, CASE WHEN label = 'spam' THEN 'spam_unlabelled' ELSE label END AS label, source FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT msg_id, label, CASE WHEN key IN (SELECT key FROM a) THEN 'sms_both' ELSE source END FROM b)")
def relabel_semi_anti(spark, sf_dir):
    keyed = dedup.with_key(corpus(spark, sf_dir))
    return dedup.relabel(keyed.filter("source = 'sms_archive'"), keyed.filter("source = 'sms_relabel'"), "sms_both").select("msg_id", "label", "source")


@query(_REL + "SELECT count(DISTINCT key) FILTER (key IN (SELECT key FROM a)) AS copied, count(DISTINCT key) FILTER (key NOT IN (SELECT key FROM a)) AS genuinely_new FROM b")
def relabel_audit(spark, sf_dir):
    keyed = dedup.with_key(corpus(spark, sf_dir))
    first = keyed.filter("source = 'sms_archive'").select("key").distinct()
    second = keyed.filter("source = 'sms_relabel'").select("key").distinct()
    both = second.join(first.withColumn("known", F.lit(True)), "key", "left")
    return both.agg(F.count(F.when(F.col("known"), 1)).alias("copied"), F.count(F.when(F.col("known").isNull(), 1)).alias("genuinely_new"))


@query("SELECT msg_id, CASE WHEN label = 'spam' THEN 'spam_unlabelled' ELSE label END AS label, source FROM corpus WHERE source = 'sms_archive' UNION ALL SELECT msg_id, label, source FROM corpus WHERE domain = 'email' UNION ALL SELECT raw_id, NULL, file FROM sms_raw")
def union_sources(spark, sf_dir):
    c = corpus(spark, sf_dir)
    archive = c.filter("source = 'sms_archive'").select("msg_id", F.when(F.col("label") == "spam", "spam_unlabelled").otherwise(F.col("label")).alias("label"), "source")
    raw = table(spark, sf_dir, "sms_raw").select(F.col("raw_id").alias("msg_id"), F.col("file").alias("source"))
    return union_messages(archive, c.filter("domain = 'email'").select("msg_id", "label", "source"), raw)


@query("SELECT domain || '-' || msg_id AS id, coalesce(text_as_packaged, text) AS packaged, CASE label WHEN 'legit' THEN 0 WHEN 'spam' THEN 1 WHEN 'phishing' THEN 2 END AS y FROM corpus")
def packaged_text(spark, sf_dir):
    return corpus(spark, sf_dir).select(message_id(F.col("domain"), F.col("msg_id")).alias("id"), F.coalesce("text_as_packaged", "text").alias("packaged"), label_index(F.col("label")).alias("y"))


@query("SELECT msg_id, coalesce(try_cast(regexp_extract(file, '(\\d{4})$', 1) AS INT), 2005) AS file_year FROM corpus WHERE source = 'mail_phish'")
def file_year(spark, sf_dir):
    year = F.expr(r"try_cast(regexp_extract(file, '(\\d{4})$', 1) AS INT)")
    return corpus(spark, sf_dir).filter("source = 'mail_phish'").select("msg_id", F.coalesce(year, F.lit(2005)).alias("file_year"))


@query("SELECT msg_id, domain, length(text) AS n_chars FROM corpus WHERE (domain = 'sms' AND length(text) BETWEEN 60 AND 500) OR (domain = 'email' AND length(text) BETWEEN 60 AND 900)")
def length_between(spark, sf_dir):
    n = F.length("text")
    return corpus(spark, sf_dir).filter(n.between(60, F.when(F.col("domain") == "sms", 500).when(F.col("domain") == "email", 900))).select("msg_id", "domain", n.alias("n_chars"))


@query("SELECT msg_id FROM corpus WHERE label IN ('legit', 'spam', 'phishing') AND lower(trim(split)) IN ('train', 'val')")
def in_list_filter(spark, sf_dir):
    return corpus(spark, sf_dir).filter(F.col("label").isin(*LABELS) & F.lower(F.trim("split")).isin("train", "val")).select("msg_id")


@query("SELECT count(*) AS n_rows, count(*) - count(label) AS null_labels, count(*) - count(split) AS null_splits, count(*) - count(\"group\") AS null_groups, count(*) - count(DISTINCT text) AS repeated_texts FROM corpus")
def null_dup_counts(spark, sf_dir):
    missing = lambda c, name: F.count(F.when(F.col(c).isNull(), 1)).alias(name)
    return corpus(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), missing("label", "null_labels"), missing("split", "null_splits"), missing("group", "null_groups"), (F.count(F.lit(1)) - F.countDistinct("text")).alias("repeated_texts"))


@query("SELECT label, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM corpus GROUP BY label")
def class_share(spark, sf_dir):
    counts = corpus(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))


@query("SELECT label, count(*) AS n_rows, round(avg(n), 6) AS mean_chars, round(stddev_samp(n), 6) AS std_chars, min(n) AS min_chars, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3, max(n) AS max_chars FROM (SELECT label, length(text) AS n FROM corpus) GROUP BY label")
def describe_by_label(spark, sf_dir):
    n = F.length("text")
    quartile = lambda q: F.percentile(n, F.lit(q))
    return corpus(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(n), 6).alias("mean_chars"), F.round(F.stddev_samp(n), 6).alias("std_chars"), F.min(n).cast("bigint").alias("min_chars"), quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"), F.max(n).cast("bigint").alias("max_chars"))


@query("SELECT domain, least(length(text) // 100, 20) AS bin, count(*) AS n_rows FROM corpus GROUP BY ALL")
def length_histogram(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("domain", F.least(F.floor(F.length("text") / 100), F.lit(20)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("WITH c AS (SELECT label, count(*) AS n FROM corpus WHERE label IN ('legit','spam','phishing') GROUP BY label), w AS (SELECT label, sqrt((SELECT sum(n) FROM c) / n::double) AS w FROM c) SELECT label, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def class_weights(spark, sf_dir):
    counts = corpus(spark, sf_dir).filter(F.col("label").isin(*LABELS)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    weights = counts.crossJoin(F.broadcast(total)).select("label", F.sqrt(F.col("total") / F.col("n")).alias("w"))
    return weights.crossJoin(F.broadcast(weights.agg(F.avg("w").alias("mean")))).select("label", F.round(F.col("w") / F.col("mean"), 6).alias("weight"))


@query("SELECT domain, label, source, year, count(*) AS n_rows FROM corpus WHERE split IS NOT NULL GROUP BY GROUPING SETS ((domain), (domain, label), (source), (year), ())")
def slice_counts(spark, sf_dir):
    corpus(spark, sf_dir).filter("split is not null").select("domain", "label", "source", "year").createOrReplaceTempView("postmill_slices")
    return spark.sql("SELECT domain, label, source, year, count(*) AS n_rows FROM postmill_slices GROUP BY GROUPING SETS ((domain), (domain, label), (source), (year), ())")


@query("SELECT msg_id, domain, label FROM (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY year, msg_id) AS r FROM corpus) WHERE r <= 20")
def head_per_group(spark, sf_dir):
    return dedup.first_per_key(corpus(spark, sf_dir), ["domain", "label"], [F.col("year").asc_nulls_last(), F.col("msg_id")], 20).select("msg_id", "domain", "label")


@query("SELECT sender, count(*) AS n_rows, count(DISTINCT source) AS n_sources, max(year) AS last_year FROM corpus WHERE sender IS NOT NULL GROUP BY sender HAVING count(*) >= 5")
def busy_senders(spark, sf_dir):
    per = corpus(spark, sf_dir).filter("sender is not null").groupBy("sender").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.max("year").alias("last_year"))
    return per.filter("n_rows >= 5")


@query("SELECT label, round(avg(CASE WHEN loaded_at > sent_at + INTERVAL 14 DAY THEN 1.0 ELSE 0.0 END), 6) AS late_share, max(date_diff('day', sent_at, loaded_at)) AS most_days FROM corpus WHERE sent_at IS NOT NULL AND loaded_at IS NOT NULL GROUP BY label")
def load_delay(spark, sf_dir):
    known = corpus(spark, sf_dir).filter("sent_at is not null and loaded_at is not null")
    late = (F.col("loaded_at") > F.col("sent_at") + F.expr("INTERVAL 14 DAYS")).cast("double")
    return known.groupBy("label").agg(F.round(F.avg(late), 6).alias("late_share"), F.max(F.datediff("loaded_at", "sent_at")).cast("bigint").alias("most_days"))


@query("SELECT msg_id, CASE label WHEN 'legit' THEN 0 WHEN 'spam' THEN 1 WHEN 'spam_unlabelled' THEN 1 WHEN 'phishing' THEN 2 END AS severity FROM corpus")
def label_severity(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", lookup(F.col("label"), SEVERITY).alias("severity"))


@query("SELECT msg_id FROM corpus WHERE domain = 'email' ORDER BY md5('400:' || msg_id), msg_id LIMIT 400")
def fixed_mail_sample(spark, sf_dir):
    """The 400 emails with the least draws: a fixed sample is the feature."""
    mail = corpus(spark, sf_dir).filter("domain = 'email'").select("msg_id", F.md5(F.concat(F.lit("400:"), F.col("msg_id").cast("string"))).alias("d"))
    return mail.orderBy("d", "msg_id").limit(400).select("msg_id")


@query("SELECT probe_id FROM probes ORDER BY md5('30:' || probe_id), probe_id LIMIT 30")
def random_probes(spark, sf_dir):
    """A draw of 30 held-out messages: a sampling operator."""
    drawn = table(spark, sf_dir, "probes").select("probe_id", F.md5(F.concat(F.lit("30:"), F.col("probe_id").cast("string"))).alias("d"))
    return drawn.orderBy("d", "probe_id").limit(30).select("probe_id")


# Twelve messages of our own, one of each kind that is easy to mistake.
PROBES = [
    (1, "sms", "legit", "Your parcel is at the corner shop, they close at six"), (2, "sms", "legit", "Bank holiday on Monday so no practice, see you Tuesday"), (3, "sms", "legit", "Code for the gate is 4471, do not ring after nine"),
    (4, "sms", "spam", "Two ringtones for the price of one, text TONE to 80808"), (5, "sms", "spam", "Win a cruise for four, every entry counts"), (6, "sms", "phishing", "We could not deliver, pay 1.99 at www.parcel-fee.example"),
    (7, "email", "legit", "Subject: minutes\nPlease find the minutes of the meeting below."), (8, "email", "legit", "Subject: password policy\nNobody will ever ask you for your password."), (9, "email", "spam", "Subject: pills\nOriginal pills without a recipe, shipped today."),
    (10, "email", "spam", "Subject: degree\nA degree on your wall in three weeks."), (11, "email", "phishing", "Subject: account\nYour account is locked, confirm your details at http://login.example"), (12, "email", "phishing", "Subject: refund\nYour refund waits, enter your card number to receive it."),
]


@query("SELECT domain, label, count(*) AS n_probes, sum(length(text))::bigint AS n_chars FROM (VALUES " + ", ".join("({}, '{}', '{}', '{}')".format(i, d, x, t.replace("'", "''")) for i, d, x, t in PROBES) + ") v(id, domain, label, text) GROUP BY ALL")
def inline_probes(spark, sf_dir):
    """A table of inline values: twelve probes, by domain and label."""
    rows = spark.createDataFrame(PROBES, "id int, domain string, label string, text string")
    return rows.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n_probes"), F.sum(F.length("text")).alias("n_chars"))
