"""Queries of a remote classifier's answer cache: newest answers, pending work, scores with refusals, latencies, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill.operators import metrics as E
from postmill.plans.corpus import CLEAN, corpus
from postmill.plans.registry import query
from postmill.runtime import table
from postmill.schema import LABELS, message_id
from postmill.sources.readers import newest

_NEW = "WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, variant, id ORDER BY seq DESC) AS r FROM llm_cache) WHERE r = 1), c AS (SELECT domain || '-' || msg_id AS id, domain, label AS truth, text FROM corpus) "


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(table(spark, sf_dir, "llm_cache"))


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(message_id(F.col("domain"), F.col("msg_id")).alias("id"), "domain", F.col("label").alias("truth"), "text")


@query(_NEW + "SELECT model, variant, id, label, secs, seq FROM n")
def history_latest(spark, sf_dir):
    return latest(spark, sf_dir).select("model", "variant", "id", "label", "secs", "seq")


@query(_NEW + f"SELECT v.model, v.variant, c.id FROM c JOIN corpus k ON c.id = k.domain || '-' || k.msg_id CROSS JOIN (SELECT DISTINCT model, variant FROM llm_cache) v WHERE {CLEAN} = 'val' AND NOT EXISTS (SELECT 1 FROM n WHERE n.model = v.model AND n.variant = v.variant AND n.id = c.id AND n.label IN ('legit', 'spam', 'phishing'))")
def pending_anti_join(spark, sf_dir):
    """Validation messages without a usable answer, for each model and variant (a handful of pairs)."""
    done = latest(spark, sf_dir).filter(F.col("label").isin(*LABELS)).select("model", "variant", "id")
    pool = corpus(spark, sf_dir).filter(F.lower(F.trim("split")) == "val").select(message_id(F.col("domain"), F.col("msg_id")).alias("id"))
    variants = table(spark, sf_dir, "llm_cache").select("model", "variant").distinct()
    return pool.crossJoin(F.broadcast(variants)).join(done, ["model", "variant", "id"], "left_anti").select("model", "variant", "id")


@query(_NEW + "SELECT id, truth, max(label) FILTER (variant = 'zero_shot') AS zero_shot, max(label) FILTER (variant = 'few_shot') AS few_shot FROM n JOIN c USING (id) GROUP BY id, truth")
def answers_wide(spark, sf_dir):
    both = latest(spark, sf_dir).join(truths(spark, sf_dir), "id")
    return both.groupBy("id", "truth").pivot("variant", ["zero_shot", "few_shot"]).agg(F.max("label"))


_REFUSED = _NEW + (
    ", j AS (SELECT model, variant, domain, label, CASE truth WHEN 'legit' THEN 0 WHEN 'spam' THEN 1 ELSE 2 END AS y, CASE label WHEN 'legit' THEN 0 WHEN 'spam' THEN 1 WHEN 'phishing' THEN 2 END AS said FROM n JOIN c USING (id) WHERE truth IN ('legit', 'spam', 'phishing')), "
    "q AS (SELECT *, coalesce(said, (y + 1) % 3) AS pred FROM j) "
)


@query(
    _REFUSED + "SELECT model, variant, domain, count(*) AS n, round(avg(CASE WHEN said IS NOT NULL AND said = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (said IS NULL) AS errors, "
    "round(coalesce(count(*) FILTER (y > 0 AND pred > 0) / nullif(count(*) FILTER (y > 0), 0), 0), 6) AS scam_recall, round(coalesce(count(*) FILTER (y = 0 AND pred > 0) / nullif(count(*) FILTER (y = 0), 0), 0), 6) AS legit_fpr FROM q GROUP BY ALL"
)
def llm_metrics_refusal(spark, sf_dir):
    rows = latest(spark, sf_dir).withColumnRenamed("label", "answer").join(truths(spark, sf_dir), "id")
    by = ["model", "variant", "domain"]
    out = E.refusal_metrics(rows, by)
    return out.select(*by, "n", F.round("accuracy", 6).alias("accuracy"), "errors", F.round("scam_recall", 6).alias("scam_recall"), F.round("legit_fpr", 6).alias("legit_fpr"))


@query(_NEW + "SELECT model, variant, count(*) AS n, count(secs) AS timed, round(quantile_cont(secs, 0.5), 6) AS median_secs, max(secs) AS most_secs FROM n GROUP BY ALL")
def latency_median(spark, sf_dir):
    rows = latest(spark, sf_dir).select("model", "variant", "secs")
    sums = rows.groupBy("model", "variant").agg(F.count(F.lit(1)).alias("n"), F.count("secs").alias("timed"), F.max("secs").alias("most_secs")).alias("s")
    middle = E.quantiles(rows, ["model", "variant"], "secs", [0.5]).alias("m")
    same = F.expr("s.model <=> m.model and s.variant <=> m.variant")
    return sums.join(middle, same, "left").select("s.model", "s.variant", "n", "timed", F.round(F.get("edges", F.lit(0)), 6).alias("median_secs"), "most_secs")


@query(_NEW + "SELECT a.model, count(*) AS n, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS agree FROM n a JOIN n b ON a.model = b.model AND a.id = b.id AND a.variant = 'zero_shot' AND b.variant = 'few_shot' GROUP BY a.model")
def variants_agree(spark, sf_dir):
    rows = latest(spark, sf_dir)
    zero = rows.filter("variant = 'zero_shot'").select("model", "id", F.col("label").alias("a"))
    few = rows.filter("variant = 'few_shot'").select("model", "id", F.col("label").alias("b"))
    same = F.coalesce((F.col("a") == F.col("b")).cast("double"), F.lit(0.0))
    return zero.join(few, ["model", "id"]).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("agree"))


@query("SELECT count(*) AS n_entries, count(DISTINCT (model, variant, id)) AS n_keys, count(*) FILTER (label IS NULL OR label NOT IN ('legit', 'spam', 'phishing')) AS n_unusable, count(*) FILTER (id NOT IN (SELECT domain || '-' || msg_id FROM corpus)) AS n_unknown FROM llm_cache")
def cache_audit(spark, sf_dir):
    known = truths(spark, sf_dir).select("id").withColumn("known", F.lit(1))
    rows = table(spark, sf_dir, "llm_cache").join(known, "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_entries"), F.countDistinct("model", "variant", "id").alias("n_keys"), F.count(F.when(F.col("label").isNull() | ~F.col("label").isin(*LABELS), 1)).alias("n_unusable"), F.count(F.when(F.col("known").isNull() & F.col("id").isNotNull(), 1)).alias("n_unknown"))


KINDS = {"sms": "text message (SMS)", "email": "email"}


@query(
    "SELECT domain, 'Label this ' || CASE domain WHEN 'sms' THEN 'text message (SMS)' ELSE 'email' END || E' as legit, spam or phishing.\\n\\n' || string_agg(E'Message:\\n' || text || E'\\nLabel: ' || label, E'\\n\\n' ORDER BY label, msg_id) AS prompt FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY md5('42:' || msg_id), msg_id) AS r FROM corpus WHERE {CLEAN} = 'train' AND label IN ('legit', 'spam', 'phishing') AND length(text) BETWEEN 60 AND CASE domain WHEN 'sms' THEN 500 ELSE 900 END) WHERE r <= 2 GROUP BY domain"
)
def prompt_template(spark, sf_dir):
    """A few-shot prompt for each domain: two examples of each label, by hash."""
    from postmill.operators.split import stratified_sample

    n = F.length("text")
    pool = corpus(spark, sf_dir).filter((F.lower(F.trim("split")) == "train") & F.col("label").isin(*LABELS) & n.between(60, F.when(F.col("domain") == "sms", 500).otherwise(900)))
    shots = stratified_sample(pool, ["domain", "label"], 2, "42")
    listed = F.array_sort(F.collect_list(F.struct("label", "msg_id", F.concat(F.lit("Message:\n"), "text", F.lit("\nLabel: "), "label").alias("shot"))))
    head = F.concat(F.lit("Label this "), F.when(F.col("domain") == "sms", KINDS["sms"]).otherwise(KINDS["email"]), F.lit(" as legit, spam or phishing.\n\n"))
    return shots.groupBy("domain").agg(listed.alias("l")).select("domain", F.concat(head, F.array_join(F.col("l.shot"), "\n\n")).alias("prompt"))


@query("SELECT raw, CASE WHEN j IN ('legit', 'spam', 'phishing') THEN j ELSE 'error' END AS label FROM (SELECT raw, json_extract_string(raw, '$.label') AS j FROM (SELECT DISTINCT '{\"label\": \"' || coalesce(label, 'none') || '\"}' AS raw FROM llm_cache))")
def json_label(spark, sf_dir):
    raw = table(spark, sf_dir, "llm_cache").select(F.concat(F.lit('{"label": "'), F.coalesce("label", F.lit("none")), F.lit('"}')).alias("raw")).distinct()
    label = F.get_json_object("raw", "$.label")
    return raw.select("raw", F.when(label.isin(*LABELS), label).otherwise("error").alias("label"))


@query(
    _NEW + ", w AS (SELECT id, max(label) FILTER (variant = 'zero_shot') AS zero_shot, max(label) FILTER (variant = 'few_shot') AS few_shot FROM n GROUP BY id) "
    "SELECT w.id, k.domain, CASE WHEN length(k.text) > 1200 THEN substr(k.text, 1, 1200) || '…' ELSE k.text END AS text, k.label, coalesce(zero_shot, 'error') AS zero_shot, coalesce(few_shot, 'error') AS few_shot FROM w JOIN corpus k ON w.id = k.domain || '-' || k.msg_id"
)
def comparison_export(spark, sf_dir):
    """What a page that compares answers shows: the message, at most 1,200 characters of it, its label and the newest answers."""
    from postmill.functions import text as T

    wide = latest(spark, sf_dir).groupBy("id").pivot("variant", ["zero_shot", "few_shot"]).agg(F.max("label"))
    shown = wide.join(truths(spark, sf_dir), "id").select("id", "domain", T.shorten(F.col("text")).alias("text"), F.col("truth").alias("label"), *(F.coalesce(v, F.lit("error")).alias(v) for v in ("zero_shot", "few_shot")))
    return shown
