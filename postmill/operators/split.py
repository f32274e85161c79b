"""Hold-outs, folds, samples and their reports. Draws are MD5s of seed and id: the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postmill.functions.text import draw
from postmill.operators.dedup import first_per_key

FUTURE_FROM, FUTURE_SOURCE, EXTERNAL_SOURCE = 2023, "mail_phish", "sms_survey"


def is_future() -> Column:
    return F.coalesce((F.col("source") == FUTURE_SOURCE) & (F.col("year") >= FUTURE_FROM), F.lit(False))


def with_future_novel(df: DataFrame) -> DataFrame:
    """`is_novel`: future rows of groups that have no older row."""
    past = df.filter(~is_future() & F.col("group").isNotNull()).select("group").distinct().withColumn("_past", F.lit(True))
    return df.join(past, "group", "left").withColumn("is_novel", is_future() & F.col("_past").isNull()).drop("_past")


def fold(group: Column, folds: int = 7, seed: str = "42") -> Column:
    return F.floor(draw(seed, group) * folds).cast("int")


def campaign_split(df: DataFrame, seed: str = "42") -> DataFrame:
    """`new_split`: future and external hold-outs, else by the fold of the group: 0 test, 1 val, others train; a group whose rows are all of unknown kind is test."""
    pooled = df.filter(~is_future() & (F.coalesce("source", F.lit("")) != EXTERNAL_SOURCE) & (F.coalesce("label", F.lit("")) != "spam_unlabelled"))
    folds = pooled.filter("`group` is not null").select("group").distinct().withColumn("_fold", fold(F.col("group"), seed=seed))
    name = F.when(F.col("source") == EXTERNAL_SOURCE, "external").when(is_future(), "future").when(F.col("_fold") >= 2, "train").when(F.col("_fold") == 1, "val").otherwise("test")
    return df.join(folds, "group", "left").withColumn("new_split", name).drop("_fold")


def stratified_folds(df: DataFrame, group: str = "group", strata: tuple[str, ...] = ("domain", "label"), folds: int = 7, seed: str = "42", buckets: int = 1024) -> DataFrame:
    """(group, stratum, fold): folds of whole groups that each hold about the same share of every stratum.

    A group's stratum is its commonest combination of `strata`. Groups fall into hash buckets, and a stratum's buckets are cut into
    `folds` runs of equally many rows: a table of strata times `buckets` cells is all that is ever sorted. Rows without a group have
    no fold.
    """
    stratum = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in strata))
    counted = df.select(F.col(group).alias("group"), stratum.alias("stratum")).filter(F.col("group").isNotNull()).groupBy("group", "stratum").agg(F.count(F.lit(1)).alias("n"))
    groups = counted.groupBy("group").agg(F.sum("n").alias("rows"), F.expr("max_by(stratum, struct(n, stratum))").alias("stratum"))
    groups = groups.withColumn("bucket", F.floor(draw(seed, F.col("group")) * buckets).cast("int"))
    cells = groups.groupBy("stratum", "bucket").agg(F.sum("rows").alias("rows"))
    middle = (F.sum("rows").over(Window.partitionBy("stratum").orderBy("bucket")) - F.col("rows") / 2) / F.sum("rows").over(Window.partitionBy("stratum"))
    placed = cells.select("stratum", "bucket", F.floor(middle * folds).cast("int").alias("fold"))
    return groups.join(placed, ["stratum", "bucket"]).select("group", "stratum", "fold")


def stratified_sample(df: DataFrame, strata: list[str], n: int, seed: str, id_col: str = "msg_id") -> DataFrame:
    """Up to `n` rows of each stratum, without replacement."""
    return first_per_key(df, strata, [F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), F.col(id_col)], n)


def stratified_holdout(df: DataFrame, stratum: str, share: float, seed: str, id_col: str = "msg_id") -> DataFrame:
    """`is_test`: the `share` of each stratum with the least draws, by a cumulative count over draw buckets that stays small whatever the stratum holds."""
    drawn = df.withColumn("_u", F.floor(draw(seed, F.col(id_col)) * 65536).cast("int"))
    cells = drawn.groupBy(stratum, "_u").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(stratum).orderBy("_u")
    before = F.sum("n").over(order) - F.col("n")
    cells = cells.withColumn("is_test", before < share * F.sum("n").over(Window.partitionBy(stratum))).select(F.col(stratum).alias("_s"), F.col("_u").alias("_v"), "is_test")
    return drawn.join(cells, drawn[stratum].eqNullSafe(cells["_s"]) & (drawn["_u"] == cells["_v"])).drop("_u", "_s", "_v")


def weighted_draw(df: DataFrame, weight: Column, n: int, seed: str, id_col: str = "msg_id") -> DataFrame:
    """(draw, id): `n` draws with replacement by weight. Weights are cumulated over BUCKETS id buckets first, then inside each bucket."""
    buckets = 4096
    rows = df.select(F.col(id_col).alias("id"), weight.cast("double").alias("w"), F.pmod(F.xxhash64(id_col), F.lit(buckets)).alias("b")).filter("w > 0")
    sums = rows.groupBy("b").agg(F.sum("w").alias("s")).withColumn("end", F.sum("s").over(Window.orderBy("b"))).withColumn("total", F.sum("s").over(Window.partitionBy()))
    spans = rows.join(sums, "b").withColumn("hi", F.col("end") - F.col("s") + F.sum("w").over(Window.partitionBy("b").orderBy("id"))).withColumn("lo", F.col("hi") - F.col("w"))
    spark = df.sparkSession
    draws = spark.range(n).select(F.col("id").alias("draw"), draw(seed, F.col("id")).alias("u"))
    targets = draws.join(sums.select(F.max("end").alias("total")).limit(1)).withColumn("x", F.col("u") * F.col("total")).drop("total")
    ranged = sums.select(F.col("b").alias("tb"), (F.col("end") - F.col("s")).alias("tlo"), F.col("end").alias("thi"))
    placed = targets.join(F.broadcast(ranged), (F.col("x") >= F.col("tlo")) & (F.col("x") < F.col("thi"))).select("draw", "x", F.col("tb").alias("b"))
    return placed.join(spans.select("b", "id", "lo", "hi"), "b").filter("x >= lo and x < hi").select("draw", "id")


def size_report(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col, "domain", "label").agg(F.count(F.lit(1)).alias("n_rows"))
