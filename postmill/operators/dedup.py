"""Exact duplicates, their audit, relabelling by a second source, and campaigns by MinHash-LSH."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postmill.functions import text as T
from postmill.operators.components import connected_components
from postmill.runtime import cut, spread
from postmill.schema import severity

LEAST_KEY = 8
LEAST_LATIN = 0.8


def with_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("key", T.dedup_key(F.col(text_col)))


def usable(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows mostly in Latin letters whose key has at least LEAST_KEY characters."""
    return with_key(df, text_col).filter((T.latin_share(F.col(text_col)) >= LEAST_LATIN) & (F.length("key") >= LEAST_KEY))


def exact_dedup(df: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """One row per (domain, key): the most severe label, then the earliest year, then the least id.

    An aggregate over the ranking columns with map-side combine, not a sorted window: a key that a third of all rows share costs one
    row per task. df: rows with `key`.
    """
    rank = F.struct((-severity(F.col("label"))).alias("s"), F.coalesce("year", F.lit(9999)).alias("y"), F.col(id_col).alias("id"))
    best = df.select("domain", "key", rank.alias("rank")).groupBy("domain", "key").agg(F.min("rank").alias("rank"))
    return df.join(best.select(F.col("rank.id").alias(id_col)), id_col, "left_semi")


def duplicate_audit(df: DataFrame) -> DataFrame:
    """By domain: rows, distinct keys, duplicates, keys with several labels. df: rows with `key`."""
    keys = df.groupBy("domain", "key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    return keys.groupBy("domain").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum((F.coalesce("a", F.lit("")) != F.coalesce("b", F.lit(""))).cast("bigint")).alias("n_conflicts")
    )


def relabel(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """`second` relabels part of `first`: its labels win, what it does not hold stays with spam of unknown kind, and its copies are named `name`.

    Semi and anti joins on distinct keys. Both: rows with `key`.
    """
    theirs = second.select("key").distinct()
    kept = first.join(theirs, "key", "left_anti").withColumn("label", F.when(F.col("label") == "spam", "spam_unlabelled").otherwise(F.col("label")))
    ours = first.select("key").distinct().withColumn("_known", F.lit(True))
    named = second.join(ours, "key", "left").withColumn("source", F.when(F.col("_known"), name).otherwise(F.col("source"))).drop("_known")
    return kept.unionByName(named)


def campaign_share(df: DataFrame) -> DataFrame:
    """By domain and label: the share of rows whose group has more than one row."""
    sizes = df.filter("`group` is not null").groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    marked = df.join(sizes, "group", "left").withColumn("in_campaign", (F.coalesce("size", F.lit(1)) > 1).cast("double"))
    return marked.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("in_campaign"), 3).alias("share_in_campaign"))


def mixed_campaigns(df: DataFrame) -> DataFrame:
    """Groups that hold both spam and phishing."""
    scams = df.filter(F.col("label").isin("spam", "phishing") & F.col("group").isNotNull())
    both = scams.groupBy("group").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n_scams"))
    return both.filter("a <> b").select("group", "n_scams")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key in `order`, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


# ---- MinHash-LSH -----------------------------------------------------------------------------------------------------------------

SHINGLE = 5
PERMUTATIONS, BANDS, ROWS = 126, 14, 9


def _parameters(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def masked(text: Column) -> Column:
    """What campaigns are compared on: lower case, blanks squeezed, digits 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), r"(?U)\d", "0")


def _shingles(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(points) < SHINGLE:
        points = np.concatenate((points, np.zeros(SHINGLE - len(points), np.uint64)))
    n = len(points) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(1_000_003) + points[k : k + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h ^ (h >> np.uint64(32))) & np.uint64(0x7FFFFFFF))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _parameters(PERMUTATIONS)
    for batch in batches:
        ids, keys = [], []
        for i, domain, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            sh = _shingles(text)
            signature = (sh * a[:, None] + b[:, None]).min(axis=1) >> np.uint64(20)  # multiply-shift hashing; a permutation at a time stays in the cache
            salt = np.uint64(hash_text(domain or ""))
            folded = np.zeros(BANDS, np.uint64)
            for r in range(ROWS):
                folded = (folded ^ signature[r::ROWS][:BANDS]) * np.uint64(0x9E3779B97F4A7C15)
                folded ^= folded >> np.uint64(31)
            folded = (folded ^ salt ^ np.arange(BANDS, dtype=np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            ids += [i] * BANDS
            keys.append(folded)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64))], names=["id", "band"])


def hash_text(value: str) -> int:
    h = 1469598103934665603
    for c in value.encode():
        h = (h ^ c) * 1099511628211 % (1 << 64)
    return h


def jaccard(a: str, b: str) -> float:
    """Exact Jaccard similarity of the sets of SHINGLE-character substrings; a shorter text is one shingle."""
    x, y = ({t[i : i + SHINGLE] for i in range(max(len(t) - SHINGLE + 1, 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def _alike(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([jaccard(a, b) >= threshold for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["lo", "hi"])

    return run


def near_duplicate_groups(df: DataFrame, id_col: str = "msg_id", text_col: str = "text", threshold: float = 0.7, verify: bool = True) -> DataFrame:
    """(id, group): campaigns by MinHash-LSH within a domain; the group is its least id.

    Rows of one band are linked to the band's least id (a star, never all pairs). verify: links are kept only if the exact Jaccard
    similarity of whole texts reaches `threshold`; without it every shared band links, as plain LSH does. Rows without id or text
    are left out.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), "domain", masked(F.col(text_col)).alias("text")).filter("id is not null and text is not null")
    bands = cut(spread(rows).mapInArrow(_bands, "id bigint, band bigint"))
    least = bands.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("band", "lo")
    links = bands.join(least, "band").filter("id > lo").select("lo", F.col("id").alias("hi")).distinct()
    if verify:
        a = rows.select(F.col("id").alias("lo"), F.col("text").alias("ta"))
        b = rows.select(F.col("id").alias("hi"), F.col("text").alias("tb"))
        links = links.join(a, "lo").join(b, "hi").select("lo", "hi", "ta", "tb").mapInArrow(_alike(threshold), "lo bigint, hi bigint")
    found = connected_components(links, "lo", "hi").withColumnRenamed("node", "id")
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("group"))
