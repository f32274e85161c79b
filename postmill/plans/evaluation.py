"""Queries of evaluation over scored messages (run_predictions, as each run scored a message last)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postmill.operators import metrics as E, models as M
from postmill.plans.corpus import CLEAN
from postmill.plans.registry import query
from postmill.runtime import table

BY = ["run", "domain"]
_DECIDE = "CASE WHEN 1 - p_legit < 0.5 THEN 0 WHEN p_spam >= p_phishing THEN 1 ELSE 2 END"
_LAST = (
    "WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, msg_id ORDER BY coalesce(scored_at, TIMESTAMP '1970-01-01') DESC, p_legit DESC, p_spam DESC) AS r FROM run_predictions "
    "WHERE run IS NOT NULL AND msg_id IS NOT NULL AND p_legit IS NOT NULL AND p_spam IS NOT NULL AND p_phishing IS NOT NULL) WHERE r = 1), "
)
_J = _LAST + f"j AS (SELECT *, CASE label WHEN 'legit' THEN 0 WHEN 'spam' THEN 1 ELSE 2 END AS y, {_DECIDE} AS pred, 1 - p_legit AS s FROM p WHERE label IN ('legit', 'spam', 'phishing')), "
J = _J.rstrip(", ") + " "
_CLASS = _J + (
    "k AS (SELECT DISTINCT run, domain, c FROM j, (VALUES (0), (1), (2)) v(c)), "
    "pc AS (SELECT k.run, k.domain, k.c, count(*) FILTER (y = c) AS support, count(*) FILTER (pred = c) AS said, count(*) FILTER (y = c AND pred = c) AS hit FROM k JOIN j ON j.run = k.run AND j.domain = k.domain GROUP BY ALL) "
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.judged(E.clean_predictions(table(spark, sf_dir, "run_predictions")))


@query(_LAST.rstrip(", ") + " SELECT run, count(*) AS n_rows, count(DISTINCT domain) AS n_domains, round(avg(p_legit), 4) AS mean_legit FROM p GROUP BY run")
def predictions_latest(spark, sf_dir):
    last = E.clean_predictions(table(spark, sf_dir, "run_predictions"))
    return last.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("domain").alias("n_domains"), F.round(F.avg("p_legit"), 4).alias("mean_legit"))


@query(f"SELECT run, msg_id, p_legit, {_DECIDE} AS pred, round(ln(greatest(least(1 - p_legit, 1 - 1e-6), 1e-6) / (1 - greatest(least(1 - p_legit, 1 - 1e-6), 1e-6))), 6) AS scam_log_odds FROM run_predictions WHERE p_legit IS NOT NULL AND p_spam IS NOT NULL AND p_phishing IS NOT NULL")
def decide(spark, sf_dir):
    rows = table(spark, sf_dir, "run_predictions").filter("p_legit is not null and p_spam is not null and p_phishing is not null")
    return rows.select("run", "msg_id", "p_legit", M.decide(F.col("p_legit"), F.col("p_spam"), F.col("p_phishing")).alias("pred"), F.round(M.log_odds(1 - F.col("p_legit")), 6).alias("scam_log_odds"))


@query(J + "SELECT g.run, g.domain, g.y, g.pred, count(j.msg_id) AS n FROM (SELECT DISTINCT run, domain, a.v AS y, b.v AS pred FROM j, (VALUES (0), (1), (2)) a(v), (VALUES (0), (1), (2)) b(v)) g LEFT JOIN j ON j.run = g.run AND j.domain = g.domain AND j.y = g.y AND j.pred = g.pred GROUP BY ALL")
def confusion(spark, sf_dir):
    return E.confusion(scored(spark, sf_dir), BY)


@query(_J + "c AS (SELECT g.run, g.domain, g.y, g.pred, count(j.msg_id) AS n FROM (SELECT DISTINCT run, domain, a.v AS y, b.v AS pred FROM j, (VALUES (0), (1), (2)) a(v), (VALUES (0), (1), (2)) b(v)) g LEFT JOIN j ON j.run = g.run AND j.domain = g.domain AND j.y = g.y AND j.pred = g.pred GROUP BY ALL) SELECT run, domain, y, pred, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY run, domain, y), 0), 0), 6) AS share FROM c")
def confusion_row_norm(spark, sf_dir):
    return E.confusion_shares(scored(spark, sf_dir), BY).drop("n")


@query(_CLASS + "SELECT run, domain, c AS class, support, round(coalesce(hit / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(said + support, 0), 0), 6) AS f1 FROM pc")
def per_class_prf(spark, sf_dir):
    return E.per_class(scored(spark, sf_dir), BY).select(*BY, "class", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(_CLASS + "SELECT run, domain, sum(support)::bigint AS n, round(avg(CASE WHEN support > 0 THEN coalesce(2 * hit / nullif(said + support, 0), 0) END), 6) AS macro_f1 FROM pc GROUP BY ALL")
def macro_f1_present(spark, sf_dir):
    return E.macro_f1(scored(spark, sf_dir), BY).select(*BY, "n", F.round("macro_f1", 6).alias("macro_f1"))


@query(_CLASS + "SELECT run, domain, sum(support)::bigint AS n, round(avg(coalesce(2 * hit / nullif(said + support, 0), 0)), 6) AS macro_f1 FROM pc GROUP BY ALL")
def macro_f1_all(spark, sf_dir):
    return E.macro_f1(scored(spark, sf_dir), BY, present_only=False).select(*BY, "n", F.round("macro_f1", 6).alias("macro_f1"))


_RATES = (
    "count(*) AS n, round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(coalesce(count(*) FILTER (y > 0 AND pred > 0) / nullif(count(*) FILTER (pred > 0), 0), 0), 6) AS scam_precision, "
    "round(coalesce(count(*) FILTER (y > 0 AND pred > 0) / nullif(count(*) FILTER (y > 0), 0), 0), 6) AS scam_recall, round(coalesce(2 * count(*) FILTER (y > 0 AND pred > 0) / nullif(count(*) FILTER (pred > 0) + count(*) FILTER (y > 0), 0), 0), 6) AS scam_f1, "
    "round(coalesce(count(*) FILTER (y = 0 AND pred > 0) / nullif(count(*) FILTER (y = 0), 0), 0), 6) AS legit_fpr, round(coalesce(count(*) FILTER (y = 2 AND pred = 2) / nullif(count(*) FILTER (y = 2), 0), 0), 6) AS phishing_recall"
)
_RATE_NAMES = ("accuracy", "scam_precision", "scam_recall", "scam_f1", "legit_fpr", "phishing_recall")


def _rates(df: DataFrame, by: list[str]) -> DataFrame:
    return E.scam_rates(df, by).select(*by, "n", *(F.round(c, 6).alias(c) for c in _RATE_NAMES))


@query(J + f"SELECT run, domain, {_RATES} FROM j GROUP BY ALL")
def scam_rates(spark, sf_dir):
    return _rates(scored(spark, sf_dir), BY)


@query(J + "SELECT run, domain, round(1 - avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM j GROUP BY ALL")
def accuracy_error_rate(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(*BY).agg(F.round(1 - F.avg((F.col("y") == F.col("pred")).cast("double")), 6).alias("error_rate"))


@query(
    _J + "d AS (SELECT run, domain, s, count(*) AS n, count(*) FILTER (y > 0) AS h FROM j GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(h) OVER w AS ch, sum(h) OVER (PARTITION BY run, domain) AS ah FROM d WINDOW w AS (PARTITION BY run, domain ORDER BY s DESC)) "
    "SELECT run, domain, round(sum(coalesce(h / nullif(ah, 0), 0) * ch / cn), 6) AS average_precision FROM c GROUP BY ALL"
)
def average_precision(spark, sf_dir):
    return E.average_precision(scored(spark, sf_dir), BY).select(*BY, F.round("average_precision", 6).alias("average_precision"))


@query(_J + "b AS (SELECT run, domain, least(floor(s * 10), 9) AS bin, count(*) AS n, sum(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS h, sum(s) AS s FROM j GROUP BY ALL) SELECT run, domain, round(sum(abs(h - s)) / sum(n), 6) AS ece FROM b GROUP BY ALL")
def ece(spark, sf_dir):
    return E.calibration_error(scored(spark, sf_dir), BY).select(*BY, F.round("ece", 6).alias("ece"))


_EDGES = ", ".join(f"quantile_cont(s, {k / 8})" for k in range(1, 8))


@query(_J + f"e AS (SELECT domain, [{_EDGES}] AS edges FROM j GROUP BY domain), b AS (SELECT j.domain, len(list_filter(edges, lambda x: s >= x)) AS bin, s, y FROM j JOIN e USING (domain)) SELECT domain, bin, count(*) AS n, round(avg(s), 4) AS mean_score, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 5) AS scam_share FROM b GROUP BY ALL")
def quantile_reliability(spark, sf_dir):
    return E.reliability(scored(spark, sf_dir), ["domain"]).select("domain", F.col("bin").cast("bigint").alias("bin"), "n", F.round("mean_score", 4).alias("mean_score"), F.round("scam_share", 5).alias("scam_share"))


@query()
def bootstrap_ci(spark, sf_dir):
    return E.bootstrap_interval(scored(spark, sf_dir), BY)


_SLICE = f"CASE WHEN {CLEAN} = 'test' THEN 'test/' || domain WHEN {CLEAN} = 'external' THEN 'external' WHEN {CLEAN} = 'future' AND future_novel THEN 'future/novel' WHEN {CLEAN} = 'future' THEN 'future/known' END"


@query(J + f"SELECT run, slice, {_RATES} FROM (SELECT *, {_SLICE} AS slice FROM j) WHERE slice IS NOT NULL GROUP BY ALL")
def slice_report(spark, sf_dir):
    s = F.lower(F.trim("split"))
    slices = F.when(s == "test", F.concat(F.lit("test/"), "domain")).when(s == "external", "external").when((s == "future") & F.col("future_novel"), "future/novel").when(s == "future", "future/known")
    return _rates(scored(spark, sf_dir).withColumn("slice", slices).filter("slice is not null"), ["run", "slice"])


@query(J + "SELECT run, domain, source, count(*) AS n, round(avg(CASE WHEN pred > 0 THEN 1.0 ELSE 0.0 END), 6) AS flagged FROM j GROUP BY GROUPING SETS ((run), (run, domain), (run, source))")
def scope_grouping_sets(spark, sf_dir):
    scored(spark, sf_dir).select("run", "domain", "source", (F.col("pred") > 0).cast("double").alias("f")).createOrReplaceTempView("postmill_scopes")
    return spark.sql("SELECT run, domain, source, count(*) AS n, round(avg(f), 6) AS flagged FROM postmill_scopes GROUP BY GROUPING SETS ((run), (run, domain), (run, source))")


@query(J + "SELECT year, CASE WHEN year <= 2007 THEN '2005-2007' WHEN year >= 2015 THEN '2015-2022' ELSE 'between' END AS era, count(*) AS n, round(avg(CASE WHEN pred > 0 THEN 1.0 ELSE 0.0 END), 6) AS scam_recall FROM j WHERE y > 0 AND year IS NOT NULL GROUP BY ALL")
def by_year_recall(spark, sf_dir):
    era = F.when(F.col("year") <= 2007, "2005-2007").when(F.col("year") >= 2015, "2015-2022").otherwise("between")
    scams = scored(spark, sf_dir).filter("y > 0 and year is not null")
    return scams.groupBy("year", era.alias("era")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") > 0).cast("double")), 6).alias("scam_recall"))


@query(_CLASS + ", m AS (SELECT run, domain, avg(CASE WHEN support > 0 THEN coalesce(2 * hit / nullif(said + support, 0), 0) END) AS f FROM pc GROUP BY ALL) SELECT domain, count(*) AS n_runs, round(avg(f), 6) AS mean_f1, round(stddev_pop(f), 6) AS std_f1 FROM m GROUP BY domain")
def seed_mean_std(spark, sf_dir):
    runs = E.macro_f1(scored(spark, sf_dir), BY)
    return runs.groupBy("domain").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.avg("macro_f1"), 6).alias("mean_f1"), F.round(F.stddev_pop("macro_f1"), 6).alias("std_f1"))


@query(
    J + "SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, round(avg(CASE WHEN a.pred = b.pred THEN 1.0 ELSE 0.0 END), 6) AS agree, round(max(greatest(abs(a.p_legit - b.p_legit), abs(a.p_spam - b.p_spam), abs(a.p_phishing - b.p_phishing))), 6) AS most_apart, "
    "round(quantile_cont(greatest(abs(a.p_legit - b.p_legit), abs(a.p_spam - b.p_spam), abs(a.p_phishing - b.p_phishing)), 0.5), 6) AS median_apart FROM j a JOIN j b ON a.msg_id = b.msg_id AND a.run < b.run GROUP BY ALL"
)
def model_agreement(spark, sf_dir):
    names = ("run", "pred", "p_legit", "p_spam", "p_phishing")
    rows = scored(spark, sf_dir).select("msg_id", *names)
    a, b = (rows.select("msg_id", *(F.col(c).alias(f"{c}_{x}") for c in names)) for x in "ab")
    apart = F.greatest(*(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in names[2:]))
    both = a.join(b, "msg_id").filter("run_a < run_b").select("run_a", "run_b", (F.col("pred_a") == F.col("pred_b")).cast("double").alias("same"), apart.alias("apart"))
    sums = both.groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("same"), 6).alias("agree"), F.round(F.max("apart"), 6).alias("most_apart"))
    middle = E.quantiles(both, ["run_a", "run_b"], "apart", [0.5])
    return sums.join(middle, ["run_a", "run_b"]).select("run_a", "run_b", "n", "agree", "most_apart", F.round(F.get("edges", F.lit(0)), 6).alias("median_apart"))


@query(J + "SELECT msg_id, any_value(label) AS label FROM j GROUP BY msg_id HAVING count(DISTINCT pred) > 1 AND count(DISTINCT label) = 1")
def disagreement_filter(spark, sf_dir):
    per = scored(spark, sf_dir).groupBy("msg_id").agg(F.countDistinct("pred").alias("k"), F.countDistinct("label").alias("l"), F.first("label").alias("label"))
    return per.filter("k > 1 and l = 1").select("msg_id", "label")


@query(
    "SELECT p.run, count(*) AS n_rows, count(c.msg_id) AS n_known, count(*) FILTER (c.msg_id IS NOT NULL AND (p.domain IS DISTINCT FROM c.domain OR p.label IS DISTINCT FROM c.label OR p.source IS DISTINCT FROM c.source OR p.year IS DISTINCT FROM c.year)) AS n_mismatched FROM run_predictions p LEFT JOIN corpus c USING (msg_id) GROUP BY p.run"
)
def index_align_check(spark, sf_dir):
    columns = ("domain", "label", "source", "year")
    truth = table(spark, sf_dir, "corpus").select("msg_id", F.struct(*columns).alias("t"))
    rows = table(spark, sf_dir, "run_predictions").select("run", "msg_id", F.struct(*columns).alias("p"))
    joined = rows.join(truth, "msg_id", "left")
    wrong = F.col("t").isNotNull() & ~F.col("t").eqNullSafe(F.col("p"))
    return joined.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), F.count("t").alias("n_known"), F.count(F.when(wrong, 1)).alias("n_mismatched"))


@query(_LAST.rstrip(", ") + " SELECT run, class, count(*) AS n, round(avg(p), 4) AS mean_p FROM (SELECT run, unnest(['p_legit', 'p_spam', 'p_phishing']) AS class, unnest([p_legit, p_spam, p_phishing]) AS p FROM p) GROUP BY ALL")
def unpivot_scores(spark, sf_dir):
    wide = E.clean_predictions(table(spark, sf_dir, "run_predictions")).select("run", "msg_id", "p_legit", "p_spam", "p_phishing")
    long = wide.unpivot(["run", "msg_id"], ["p_legit", "p_spam", "p_phishing"], "class", "p")
    return long.groupBy("run", "class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 4).alias("mean_p"))


@query(_CLASS + ", f AS (SELECT run, domain, avg(CASE WHEN support > 0 THEN coalesce(2 * hit / nullif(said + support, 0), 0) END) AS f FROM pc GROUP BY ALL), s AS (SELECT run, sum(f) AS total FROM f GROUP BY run) SELECT run, round(total, 6) AS total_f1, row_number() OVER (ORDER BY round(total, 6) DESC, run) AS place FROM s")
def card_sort(spark, sf_dir):
    """Runs in the order of their macro-F1 summed over domains (as many rows as runs)."""
    totals = E.macro_f1(scored(spark, sf_dir), BY).groupBy("run").agg(F.round(F.sum("macro_f1"), 6).alias("total_f1"))
    return totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total_f1"), "run")))


@query(
    _CLASS + f", f AS (SELECT run, domain, round(avg(CASE WHEN support > 0 THEN coalesce(2 * hit / nullif(said + support, 0), 0) END), 6) AS macro_f1 FROM pc GROUP BY ALL), r AS (SELECT run, domain, {_RATES} FROM j GROUP BY ALL), "
    "b AS (SELECT run, domain, least(floor(s * 10), 9) AS bin, count(*) AS n, sum(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS h, sum(s) AS s FROM j GROUP BY ALL), c AS (SELECT run, domain, round(sum(abs(h - s)) / sum(n), 6) AS ece FROM b GROUP BY ALL) "
    "SELECT run, domain, n, macro_f1, scam_recall, legit_fpr, ece FROM r JOIN f USING (run, domain) JOIN c USING (run, domain)"
)
def model_card(spark, sf_dir):
    """What a model card says of each run and domain."""
    rows = scored(spark, sf_dir)
    f1 = E.macro_f1(rows, BY).select(*BY, F.round("macro_f1", 6).alias("macro_f1"))
    calibration = E.calibration_error(rows, BY).select(*BY, F.round("ece", 6).alias("ece"))
    return _rates(rows, BY).join(f1, BY).join(calibration, BY).select(*BY, "n", "macro_f1", "scam_recall", "legit_fpr", "ece")


_ERA = "CASE WHEN year <= 2007 THEN '2005-2007' WHEN year >= 2015 THEN '2015-2022' ELSE 'between' END"


@query(J + f"SELECT run, {_ERA} AS era, {_RATES} FROM j WHERE year IS NOT NULL GROUP BY ALL")
def era_report(spark, sf_dir):
    era = F.when(F.col("year") <= 2007, "2005-2007").when(F.col("year") >= 2015, "2015-2022").otherwise("between")
    return _rates(scored(spark, sf_dir).filter("year is not null").withColumn("era", era), ["run", "era"])


@query(_LAST.rstrip(", ") + f" SELECT run, domain, count(*) AS n, round(avg(CASE WHEN {_DECIDE} > 0 THEN 1.0 ELSE 0.0 END), 6) AS flagged, round(avg(CASE WHEN {_DECIDE} = 2 THEN 1.0 ELSE 0.0 END), 6) AS called_phishing FROM p WHERE label = 'spam_unlabelled' GROUP BY ALL")
def unlabelled_report(spark, sf_dir):
    """What runs make of spam whose kind nobody labelled."""
    rows = E.clean_predictions(table(spark, sf_dir, "run_predictions")).filter("label = 'spam_unlabelled'")
    pred = M.decide(F.col("p_legit"), F.col("p_spam"), F.col("p_phishing"))
    return rows.withColumn("pred", pred).groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") > 0).cast("double")), 6).alias("flagged"), F.round(F.avg((F.col("pred") == 2).cast("double")), 6).alias("called_phishing"))


_RUNS = ("s7", "s13", "s42")


@query(_LAST.rstrip(", ") + " SELECT msg_id, " + ", ".join(f"max(p_legit) FILTER (run = '{r}') AS {r}__p_legit" for r in _RUNS) + " FROM p GROUP BY msg_id")
def predictions_wide(spark, sf_dir):
    last = E.clean_predictions(table(spark, sf_dir, "run_predictions"))
    wide = last.groupBy("msg_id").pivot("run", list(_RUNS)).agg(F.max("p_legit"))
    return wide.select("msg_id", *(F.col(r).alias(f"{r}__p_legit") for r in _RUNS))


_GRID = "SELECT 0.5 + i * (2.5 / 25) AS t FROM range(26) r(i)"


@query(J + f"SELECT round(t, 6) AS temperature, round(avg(ln(exp(z0 / t) + exp(z1 / t) + exp(z2 / t)) - CASE y WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END / t), 6) AS nll FROM (SELECT y, ln(greatest(p_legit, 1e-12)) AS z0, ln(greatest(p_spam, 1e-12)) AS z1, ln(greatest(p_phishing, 1e-12)) AS z2 FROM j) CROSS JOIN ({_GRID}) GROUP BY t")
def temperature_grid(spark, sf_dir):
    return M.temperature_grid(scored(spark, sf_dir)).select(F.round("temperature", 6).alias("temperature"), F.round("nll", 6).alias("nll"))
