"""Evaluation of scored messages as aggregates over (by..., y, pred, p_legit): results are long tables.

y and pred count 0 legit, 1 spam, 2 phishing. `by` names the columns whose values are scored apart.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postmill.operators.models import decide
from postmill.schema import label_index

BINS = 4096


def clean_predictions(df: DataFrame) -> DataFrame:
    """Runs' predictions as scored last: doubled rows once, of several scores of a message by a run the newest, rows without a run, message or probability out."""
    whole = df.filter("run is not null and msg_id is not null and p_legit is not null and p_spam is not null and p_phishing is not null")
    order = F.struct(F.coalesce("scored_at", F.lit("1970-01-01").cast("timestamp")), "p_legit", "p_spam")
    rest = [c for c in whole.columns if c not in ("run", "msg_id")]
    best = whole.groupBy("run", "msg_id").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select("run", "msg_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def judged(df: DataFrame) -> DataFrame:
    """Rows with a known label, with y and pred."""
    out = df.withColumn("y", label_index(F.col("label"))).filter("y is not null")
    return out.withColumn("pred", decide(F.col("p_legit"), F.col("p_spam"), F.col("p_phishing")))


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., y, pred, n), all nine cells of each value."""
    counted = df.groupBy(*by, "y", "pred").agg(F.count(F.lit(1)).alias("n"))
    three = df.sparkSession.range(3)
    grid = df.select(*by).distinct().crossJoin(F.broadcast(three.select(F.col("id").cast("int").alias("y")))).crossJoin(F.broadcast(three.select(F.col("id").cast("int").alias("pred"))))
    match = [grid[c].eqNullSafe(counted[c]) for c in [*by, "y", "pred"]]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return grid.join(counted, cond, "left").select(*(grid[c] for c in [*by, "y", "pred"]), F.coalesce(counted["n"], F.lit(0)).alias("n"))


def confusion_shares(df: DataFrame, by: Sequence[str]) -> DataFrame:
    cells = confusion(df, by)
    total = F.sum("n").over(Window.partitionBy(*by, "y"))
    return cells.withColumn("share", F.round(_share(F.col("n"), total), 6))


def per_class(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., class, support, precision, recall, f1); 0 where nothing was predicted or present."""
    cells = confusion(df, by)
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")))).alias("s")).select(*by, "s.*")
    sums = sides.groupBy(*by, "class").agg(F.sum("actual").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    return sums.select(*by, "class", "support", _share(F.col("hit"), F.col("said")).alias("precision"), _share(F.col("hit"), F.col("support")).alias("recall"), _share(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"))


def macro_f1(df: DataFrame, by: Sequence[str], present_only: bool = True) -> DataFrame:
    """(by..., n, macro_f1): over the classes that occur, or over all three."""
    classes = per_class(df, by)
    f1 = F.when((F.col("support") > 0) | F.lit(not present_only), F.col("f1"))
    return classes.groupBy(*by).agg(F.sum("support").alias("n"), F.avg(f1).alias("macro_f1"))


def scam_rates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n, accuracy, scam_precision, scam_recall, scam_f1, legit_fpr, phishing_recall)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    scam, flagged = F.col("y") > 0, F.col("pred") > 0
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), count(F.col("y") == F.col("pred")).alias("right"), count(scam & flagged).alias("tp"), count(~scam & flagged).alias("fp"), count(scam).alias("scams"), count(~scam).alias("legits"),
        count((F.col("y") == 2) & (F.col("pred") == 2)).alias("p_hit"), count(F.col("y") == 2).alias("p_all"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    return sums.select(*by, "n", (F.col("right") / F.col("n")).alias("accuracy"), _share(tp, tp + fp).alias("scam_precision"), _share(tp, F.col("scams")).alias("scam_recall"), _share(2 * tp, tp + fp + F.col("scams")).alias("scam_f1"), _share(fp, F.col("legits")).alias("legit_fpr"), _share(F.col("p_hit"), F.col("p_all")).alias("phishing_recall"))


def average_precision(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., average_precision): sum of recall steps times precision over distinct scores 1 - p_legit, highest first.

    Counts are cumulated over score bins first and inside a bin after, so no task sorts more than a bin.
    """
    at = df.select(*by, (1 - F.col("p_legit")).alias("score"), (F.col("y") > 0).cast("int").alias("hit"))
    steps = at.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")).withColumn("bin", F.floor(F.col("score") * BINS))
    bins = steps.groupBy(*by, "bin").agg(F.sum("n").alias("bn"), F.sum("hits").alias("bh"))
    above = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*by, "bin", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("bh").over(above), F.lit(0)).alias("h0"), F.sum("bh").over(Window.partitionBy(*by)).alias("all_hits"))
    inside = Window.partitionBy(*by, "bin").orderBy(F.desc("score"))
    s, b = steps.alias("s"), bins.alias("b")
    cond = F.col("s.bin") == F.col("b.bin")
    for c in by:
        cond = cond & F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = s.join(b, cond).select(*(F.col(f"s.{c}").alias(c) for c in by), F.col("s.bin").alias("bin"), "score", "n", "hits", "n0", "h0", "all_hits")
    run = joined.withColumn("cn", F.col("n0") + F.sum("n").over(inside)).withColumn("ch", F.col("h0") + F.sum("hits").over(inside))
    return run.groupBy(*by).agg(F.sum(_share(F.col("hits"), F.col("all_hits")) * F.col("ch") / F.col("cn")).alias("average_precision"))


def calibration_error(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """(by..., ece): equal bins of the scam score, left-closed, 1 in the last."""
    score = 1 - F.col("p_legit")
    binned = df.select(*by, score.alias("s"), (F.col("y") > 0).cast("double").alias("hit"), F.least(F.floor(score * bins), F.lit(bins - 1)).alias("bin"))
    cells = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"), F.sum("s").alias("s"))
    return cells.groupBy(*by).agg((F.sum(F.abs(F.col("h") - F.col("s"))) / F.sum("n")).alias("ece"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by..., edges): exact interpolated quantiles of `value` at `shares`, without a group's values in one task.

    Counts by distinct value are cumulated over BINS bins of the value's range first and inside a bin after, so no task sorts more than
    a bin. Null values do not count.
    """
    steps = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    span = steps.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("n").alias("total"))
    s, r = steps.alias("s"), span.alias("r")
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))
    placed = s.join(r, _same(by, "s", "r")).select(*(F.col(f"s.{c}").alias(c) for c in by), F.col(value).alias("v"), "n", "total", F.floor((F.col(value) - F.col("lo")) / width * BINS).alias("bin"))
    bins = placed.groupBy(*by, "bin").agg(F.sum("n").alias("bn"), F.first("total").alias("total"))
    before = F.sum("bn").over(Window.partitionBy(*by).orderBy("bin")) - F.col("bn")
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(float(x)) * (F.col("total") - 1)).alias("rank")) for k, x in enumerate(shares)))
    asked = bins.withColumn("n0", before).withColumn("w", F.explode(wanted))
    # a quantile lies between the values at the ranks below and above it, which may stand in two bins
    hit = asked.filter((F.floor("w.rank") >= F.col("n0")) & (F.floor("w.rank") < F.col("n0") + F.col("bn")) | (F.ceil("w.rank") >= F.col("n0")) & (F.ceil("w.rank") < F.col("n0") + F.col("bn")))
    inside = Window.partitionBy(*by, "bin").orderBy("v")
    p, h = placed.withColumn("c", F.sum("n").over(inside)).alias("p"), hit.alias("h")
    met = p.join(h, _same([*by, "bin"], "p", "h")).select(*(F.col(f"p.{c}").alias(c) for c in by), "v", (F.col("n0") + F.col("c") - F.col("n")).alias("from"), (F.col("n0") + F.col("c")).alias("to"), F.col("w.k").alias("k"), F.col("w.rank").alias("rank"))
    at = lambda x: F.max(F.when((x >= F.col("from")) & (x < F.col("to")), F.col("v")))
    ends = met.groupBy(*by, "k").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"), F.first("rank").alias("rank"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    return ends.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value_at.alias("v")))), lambda x: x["v"]).alias("edges"))


def _same(columns: Sequence[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def reliability(df: DataFrame, by: Sequence[str], bins: int = 8) -> DataFrame:
    """(by..., bin, n, mean_score, scam_share) over quantile bins of the scam score."""
    scored = df.select(*by, (1 - F.col("p_legit")).alias("s"), (F.col("y") > 0).cast("double").alias("hit"))
    edges = quantiles(scored, by, "s", [k / bins for k in range(1, bins)])
    over = F.size(F.filter("edges", lambda x: F.col("s") >= x)).alias("bin")
    binned = scored.alias("a").join(edges.alias("e"), _same(by, "a", "e")).select(*(F.col(f"a.{c}").alias(c) for c in by), "s", "hit", over)
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_score"), F.avg("hit").alias("scam_share"))


def bootstrap_interval(df: DataFrame, by: Sequence[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """(by..., low, high): 2.5 and 97.5 percentiles of macro-F1 over resamples of the confusion cells, which is the resampling of rows at a size that does not grow with them."""
    cells = confusion(df, by)

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((3, 3))
        n[frame["y"], frame["pred"]] = frame["n"]
        total = int(n.sum())
        rng = np.random.default_rng(seed)
        sample = rng.multinomial(total, n.ravel() / max(total, 1), size=draws).reshape(-1, 3, 3)
        hit, actual, said = np.einsum("kii->ki", sample), sample.sum(2), sample.sum(1)
        f1 = np.where(actual + said > 0, 2 * hit / np.maximum(actual + said, 1), 0.0)
        present = n.sum(1) > 0
        scores = f1[:, present].mean(1) if present.any() else np.zeros(draws)
        return pd.DataFrame([[*keys, *np.percentile(scores, [2.5, 97.5])]], columns=[*by, "low", "high"])

    kinds = dict(df.dtypes)
    return cells.groupBy(*by).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "low double", "high double"]))


def refusal_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores of label answers that may be refusals: y from `truth`, an answer outside the labels counts as a wrong one and as an error."""
    y, p = label_index(F.col("truth")), label_index(F.col("answer"))
    rows = df.withColumn("y", y).filter("y is not null").withColumn("said", p)
    rows = rows.withColumn("pred", F.coalesce("said", (F.col("y") + 1) % 3))
    rates = scam_rates(rows, by).drop("accuracy")
    wrong = rows.groupBy(*by).agg(F.avg((F.col("y") == F.coalesce("said", F.lit(-1))).cast("double")).alias("accuracy"), F.sum(F.isnull("said").cast("bigint")).alias("errors"))
    macro = macro_f1(rows, by).drop("n")
    return rates.join(wrong, list(by)).join(macro, list(by))
