"""Queries of campaigns, splits, samples and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators import dedup, split
from postmill.operators.components import connected_components
from postmill.plans.corpus import CLEAN, KEY, corpus
from postmill.plans.registry import query


@query('SELECT domain, label, count(*) AS n_rows, round(avg(CASE WHEN coalesce(size, 1) > 1 THEN 1.0 ELSE 0.0 END), 3) AS share_in_campaign FROM corpus LEFT JOIN (SELECT "group", count(*) AS size FROM corpus WHERE "group" IS NOT NULL GROUP BY 1) USING ("group") GROUP BY domain, label')
def campaign_share(spark, sf_dir):
    return dedup.campaign_share(corpus(spark, sf_dir))


@query("SELECT \"group\", count(*) AS n_scams FROM corpus WHERE label IN ('spam', 'phishing') AND \"group\" IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) > 1")
def mixed_campaigns(spark, sf_dir):
    return dedup.mixed_campaigns(corpus(spark, sf_dir))


@query('SELECT "group", count(*) AS n_rows, count(DISTINCT source) AS n_sources, min(year) AS first_year, max(year) AS last_year FROM corpus WHERE "group" IS NOT NULL GROUP BY 1')
def campaign_sizes(spark, sf_dir):
    rows = corpus(spark, sf_dir).filter("`group` is not null")
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


_FUTURE = "coalesce(source = 'mail_phish' AND year >= 2023, false)"


@query(f'SELECT msg_id, {_FUTURE} AND ("group" IS NULL OR "group" NOT IN (SELECT "group" FROM corpus WHERE "group" IS NOT NULL AND NOT {_FUTURE})) AS is_novel FROM corpus')
def future_novel(spark, sf_dir):
    return split.with_future_novel(corpus(spark, sf_dir)).select("msg_id", "is_novel")


_FOLD = "floor(('0x' || substr(md5('42:' || \"group\"), 1, 8))::bigint / 4294967296.0 * 7)::int"


@query(
    f"WITH f AS (SELECT DISTINCT \"group\", {_FOLD} AS fold FROM corpus WHERE \"group\" IS NOT NULL AND NOT {_FUTURE} AND coalesce(source, '') <> 'sms_survey' AND coalesce(label, '') <> 'spam_unlabelled') "
    f"SELECT msg_id, CASE WHEN source = 'sms_survey' THEN 'external' WHEN {_FUTURE} THEN 'future' WHEN fold >= 2 THEN 'train' WHEN fold = 1 THEN 'val' ELSE 'test' END AS new_split FROM corpus LEFT JOIN f USING (\"group\")"
)
def group_split(spark, sf_dir):
    return split.campaign_split(corpus(spark, sf_dir)).select("msg_id", "new_split")


@query(f'SELECT "group", count(DISTINCT {CLEAN}) AS n_splits FROM corpus WHERE "group" IS NOT NULL AND {CLEAN} IN (\'train\', \'val\', \'test\') GROUP BY 1 HAVING count(DISTINCT {CLEAN}) > 1')
def split_leakage(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("s", F.lower(F.trim("split"))).filter("`group` is not null and s in ('train', 'val', 'test')")
    return rows.groupBy("group").agg(F.countDistinct("s").alias("n_splits")).filter("n_splits > 1")


@query(f"WITH k AS (SELECT {CLEAN} AS s, domain, {KEY} AS key FROM corpus) SELECT domain, count(*) AS n_test, round(avg(CASE WHEN key IN (SELECT key FROM k WHERE s = 'train') THEN 1.0 ELSE 0.0 END), 6) AS copied_share FROM k WHERE s = 'test' GROUP BY domain")
def leakage_exact_copy(spark, sf_dir):
    keyed = dedup.with_key(corpus(spark, sf_dir)).select(F.lower(F.trim("split")).alias("s"), "domain", "key")
    train = keyed.filter("s = 'train'").select("key").distinct().withColumn("copied", F.lit(1.0))
    tested = keyed.filter("s = 'test'").join(train, "key", "left")
    return tested.groupBy("domain").agg(F.count(F.lit(1)).alias("n_test"), F.round(F.avg(F.coalesce("copied", F.lit(0.0))), 6).alias("copied_share"))


@query("SELECT msg_id, domain, label FROM (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY md5('7:' || msg_id), msg_id) AS r FROM corpus) WHERE r <= 50")
def stratified_sample(spark, sf_dir):
    return split.stratified_sample(corpus(spark, sf_dir), ["domain", "label"], 50, "7").select("msg_id", "domain", "label")


_U = "floor(('0x' || substr(md5('3:' || msg_id), 1, 8))::bigint / 4294967296.0 * 65536)::int"


@query(
    f"WITH d AS (SELECT msg_id, label, {_U} AS u FROM corpus), c AS (SELECT label, u, count(*) AS n FROM d GROUP BY ALL), e AS (SELECT label, u, sum(n) OVER (PARTITION BY label ORDER BY u) - n < 0.15 * sum(n) OVER (PARTITION BY label) AS is_test FROM c) "
    "SELECT d.msg_id, e.is_test FROM d JOIN e ON d.label IS NOT DISTINCT FROM e.label AND d.u = e.u"
)
def stratified_holdout(spark, sf_dir):
    return split.stratified_holdout(corpus(spark, sf_dir), "label", 0.15, "3").select("msg_id", "is_test")


@query()
def weighted_draw(spark, sf_dir):
    """A draw with replacement in which each domain weighs as the root of its rows; its domain counts."""
    rows = corpus(spark, sf_dir)
    sizes = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    weighed = rows.join(F.broadcast(sizes), "domain").withColumn("w", 1 / F.sqrt("n"))
    drawn = split.weighted_draw(weighed, F.col("w"), 2000, "5")
    return drawn.join(rows.select(F.col("msg_id").alias("id"), "domain"), "id").groupBy("domain").agg(F.count(F.lit(1)).alias("n_draws"))


@query()
def minhash_groups(spark, sf_dir):
    """Campaigns as the reference forms them: every shared band links."""
    return dedup.near_duplicate_groups(corpus(spark, sf_dir), verify=False).withColumnsRenamed({"id": "msg_id", "group": "campaign"})


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT a.\"group\" AS x, b.\"group\" AS y FROM corpus a JOIN corpus b ON a.domain = b.domain AND a.text = b.text AND a.\"group\" <> b.\"group\"), "
    "r(x, root) AS (SELECT x, x FROM (SELECT x FROM e UNION SELECT y FROM e) UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x) SELECT x AS \"group\", min(root) AS merged FROM r GROUP BY x"
)
def merged_groups(spark, sf_dir):
    """Groups that share an exact text, closed over chains."""
    rows = corpus(spark, sf_dir).filter("`group` is not null").select("domain", F.md5("text").alias("t"), "group").distinct()
    least = rows.groupBy("domain", "t").agg(F.min("group").alias("least"))
    links = rows.join(least, ["domain", "t"]).filter("`group` <> least")
    return connected_components(links, "group", "least").withColumnsRenamed({"node": "group", "component": "merged"})


@query(f"SELECT domain, label, count(*) AS n_rows, count(DISTINCT {KEY}) AS n_keys FROM corpus WHERE {CLEAN} = 'train' AND label IS NOT NULL AND length(text) >= 60 GROUP BY ALL")
def shot_pool(spark, sf_dir):
    """What few-shot examples may be drawn from, by domain and label."""
    rows = dedup.with_key(corpus(spark, sf_dir)).filter((F.lower(F.trim("split")) == "train") & F.col("label").isNotNull() & (F.length("text") >= 60))
    return rows.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("key").alias("n_keys"))


_POOL = f"SELECT \"group\", coalesce(domain, '-') || '/' || coalesce(label, '-') AS stratum FROM corpus WHERE \"group\" IS NOT NULL AND NOT {_FUTURE} AND coalesce(source, '') <> 'sms_survey' AND coalesce(label, '') <> 'spam_unlabelled'"


@query(
    f"WITH p AS ({_POOL}), c AS (SELECT \"group\", stratum, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT \"group\", sum(n)::bigint AS rows, arg_max(stratum, (n, stratum)) AS stratum FROM c GROUP BY 1), "
    "b AS (SELECT *, floor(('0x' || substr(md5('42:' || \"group\"), 1, 8))::bigint / 4294967296.0 * 1024)::int AS bucket FROM g), k AS (SELECT stratum, bucket, sum(rows) AS rows FROM b GROUP BY ALL), "
    "m AS (SELECT stratum, bucket, floor((sum(rows) OVER (PARTITION BY stratum ORDER BY bucket) - rows / 2) / sum(rows) OVER (PARTITION BY stratum) * 7)::int AS fold FROM k) SELECT \"group\", stratum, fold FROM b JOIN m USING (stratum, bucket)"
)
def stratified_folds(spark, sf_dir):
    """Seven folds of whole campaigns, each with its share of every domain and label; future, external and unlabelled rows are held out."""
    pool = corpus(spark, sf_dir).filter(~split.is_future() & (F.coalesce("source", F.lit("")) != split.EXTERNAL_SOURCE) & (F.coalesce("label", F.lit("")) != "spam_unlabelled"))
    return split.stratified_folds(pool)
