"""Problem 4: train, validation and test splits that keep related records together.

Records that share any entity (a group, an exact text, ...) are linked, `connected_components` (large-star small-star) closes the
links, and the component's hash falls into a range of its stratum. The stratum of a component is its commonest (domain, label) and
its size class; the ranges of a stratum are cut at the proportions of its rows over BUCKETS hash buckets, a table whose size depends
on the number of strata only. A component is never divided, whatever its size: one of more than GIANT of all rows goes to the first
split, and the shares of the others are set so that all rows together keep the proportions, as far as that can be. Senders and
campaigns that link one another tend to such a component.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postmill.functions.text import draw
from postmill.operators.components import connected_components
from postmill.runtime import cut, table

BUCKETS = 1024
GIANT = 0.2
SPLITS = {"train": 0.70, "val": 0.15, "test": 0.15}


def record_components(df: DataFrame, entities: Sequence[str], id_col: str = "msg_id") -> DataFrame:
    """(id, component) for every row with an id; rows that share a non-null value of an entity column, directly or through others, are one component.

    Each value links its rows to its least id: the links are as many as the rows, however hot a value is.
    """
    links = None
    for column in entities:
        rows = df.select(F.col(id_col).alias("id"), F.col(column).alias("value")).filter("id is not null and value is not null")
        if dict(rows.dtypes)["value"] == "string":
            rows = rows.withColumn("value", F.unhex(F.md5("value")))
        least = rows.groupBy("value").agg(F.min("id").alias("least"))
        star = rows.join(least, "value").filter("id <> least").select("id", "least")
        links = star if links is None else links.union(star)
    ids = df.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    if links is None:
        return ids.select("id", F.col("id").alias("component"))
    found = connected_components(links, "id", "least").withColumnRenamed("node", "id")
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def grouped_split(df: DataFrame, entities: Sequence[str], strata: Sequence[str] = ("domain", "label"), splits: Mapping[str, float] = SPLITS, id_col: str = "msg_id", seed: int = 42) -> DataFrame:
    """(id, component, split) for every distinct id.

    Null entities link nothing, null strata are a value of their own, an empty table gives an empty result; `splits` maps names to
    shares that sum to 1 and are taken in their order. Columns named like the result's are read only if asked for.
    """
    parts = cut(record_components(df, entities, id_col))
    stratum = F.concat_ws("/", *(F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("-")) for c in strata)) if strata else F.lit("all")
    marked = df.select(F.col(id_col).alias("id"), stratum.alias("stratum")).filter("id is not null").groupBy("id").agg(F.min("stratum").alias("stratum"))
    counted = marked.join(parts, "id").groupBy("component", "stratum").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy("component").agg(F.sum("n").alias("rows"), F.expr("max_by(stratum, struct(n, stratum))").alias("stratum"))
    place = F.floor(draw(str(seed), F.col("component")) * BUCKETS).cast("int")
    placed = cut(whole.select("component", "rows", "stratum", F.length(F.bin("rows")).alias("size_class"), place.alias("bucket")))
    total = placed.agg(F.sum("rows").alias("total"))
    sized = placed.crossJoin(F.broadcast(total)).withColumn("giant", F.col("rows") > GIANT * F.col("total"))  # one row
    names, shares = list(splits), list(splits.values())
    held = sized.agg(F.first("total").alias("total"), F.sum(F.when(F.col("giant"), F.col("rows")).otherwise(0)).alias("held"))
    first = F.greatest(shares[0] * F.col("total") - F.col("held"), F.lit(0.0)) / F.greatest(F.col("total") - F.col("held"), F.lit(1))
    held = held.select(F.when(F.col("held") == 0, F.lit(shares[0])).otherwise(first).alias("first"))  # one row
    rest = sized.filter("not giant").groupBy("stratum", "size_class", "bucket").agg(F.sum("rows").alias("rows"))
    order = Window.partitionBy("stratum", "size_class").orderBy("bucket")
    middle = (F.sum("rows").over(order) - F.col("rows") / 2) / F.sum("rows").over(Window.partitionBy("stratum", "size_class"))
    split, edge = F.lit(names[-1]), sum(shares[:-1])
    for name, share in list(zip(names, shares))[-2::-1]:
        bound = F.col("first") + (1 - F.col("first")) * ((edge - shares[0]) / max(1 - shares[0], 1e-12))
        split = F.when(F.col("middle") < bound - 1e-12, name).otherwise(split)
        edge -= share
    ranges = rest.withColumn("middle", middle).crossJoin(F.broadcast(held)).select("stratum", "size_class", "bucket", split.alias("range"))
    chosen = sized.join(ranges, ["stratum", "size_class", "bucket"], "left").select("component", F.when(F.col("giant"), names[0]).otherwise(F.col("range")).alias("split"))
    return parts.join(chosen, "component").select("id", "component", "split")


def leaking(df: DataFrame, entity: str = "group", split_col: str = "split", names: Sequence[str] = tuple(SPLITS), id_col: str = "msg_id") -> DataFrame:
    """(entity): each non-null value whose rows stand in two or more of the splits `names`, taken without case and outer blanks.

    A value can only leak inside a component that leaks; the values of such components are then checked one by one.
    """
    named = F.lower(F.regexp_replace(F.col(split_col), r"(?U)^\s+|\s+$", ""))
    rows = df.select(F.col(id_col).alias("id"), F.col(entity).alias("value"), named.alias("split")).filter(F.col("split").isin(*names))
    parts = record_components(df, [entity], id_col)
    spread = [F.min("split").alias("s"), F.max("split").alias("t")]
    inside = cut(rows.join(parts, "id").select("component", "value", "split"))
    split_up = inside.groupBy("component").agg(*spread).filter("s <> t").select("component")
    suspects = inside.filter("value is not null").join(split_up, "component", "left_semi")
    return suspects.groupBy("value").agg(*spread).filter("s <> t").select(F.col("value").alias(entity))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaking(table(spark, sf_dir, "corpus")).withColumnRenamed("group", "group_id")


def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns and exact copies kept together, as the problem is stated for this data."""
    found = grouped_split(table(spark, sf_dir, "corpus"), ["group", "text"])
    return found.select(F.col("id").alias("msg_id"), "component", "split")


def p4_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns, exact copies and senders kept together: most senders are linked through campaigns."""
    found = grouped_split(table(spark, sf_dir, "corpus"), ["group", "text", "sender"])
    return found.select(F.col("id").alias("msg_id"), "component", "split")
