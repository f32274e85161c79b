"""Sinks: the corpus, predictions, metric reports, caches and bundles. Writers overwrite whole tables or append; nothing is collected but small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postmill.schema import LABELS

ONE_FILE = 10_000


def write_corpus(df: DataFrame, path: str) -> None:
    """Parquet by split and domain, so that a reader of one split prunes the others."""
    df.repartition("split", "domain", F.pmod(F.xxhash64("msg_id"), F.lit(16))).write.mode("overwrite").partitionBy("split", "domain").option("compression", "zstd").parquet(path)


def wide_predictions(df: DataFrame, models: list[str], keys: list[str], model_col: str = "run") -> DataFrame:
    """One row a message, columns {model}__p_{label}. `models` is the list of columns, so no pass over the data finds them."""
    wide = df.groupBy(*keys).pivot(model_col, models).agg(*(F.max(f"p_{x}").alias(f"p_{x}") for x in LABELS))
    return wide.select(*keys, *(F.col(f"{m}_p_{x}").alias(f"{m}__p_{x}") for m in models for x in LABELS))


def write_report(df: DataFrame, path: str) -> None:
    """A long metric table as JSON lines: one file, unless it has more than ONE_FILE rows."""
    small = df.limit(ONE_FILE + 1).count() <= ONE_FILE
    (df.coalesce(1) if small else df).write.mode("overwrite").json(path)


def report_json(df: DataFrame, scope: str, metric: str, value: str) -> DataFrame:
    """One row: the metric table as a JSON object of objects, scope by scope."""
    per = df.groupBy(scope).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(metric), F.col(value))))).alias("m"))
    return per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(scope), "m")))).alias("report"))


def append_cache(df: DataFrame, path: str) -> None:
    """Entries of an append-only JSON-lines cache; a later `seq` wins when it is read."""
    df.write.mode("append").json(path)


def bundle_digest(df: DataFrame) -> DataFrame:
    """(path, sha256 prefix, bytes) of a binaryFile table."""
    return df.select("path", F.substring(F.sha2("content", 256), 1, 12).alias("digest"), F.length("content").alias("n_bytes"))


def write_bundle(df: DataFrame, path: str) -> DataFrame:
    """Write a table under a folder named by the digest of its rows, and return (digest, n_rows): equal tables have equal names whatever their order."""
    row = F.xxhash64(*df.columns)
    mark = df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("y"))
    named = mark.select(F.substring(F.sha2(F.concat_ws(":", "n_rows", "x", "y"), 256), 1, 12).alias("digest"), "n_rows").first()
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/{named['digest']}")
    return df.sparkSession.createDataFrame([tuple(named)], "digest string, n_rows bigint")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
