"""Streams of messages: the batch operators over readStream. An extension; the engine's batch results do not depend on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postmill.functions import text as T


def read_messages(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepared(df: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    return df.withColumn("prepared", T.prepare(F.col("text"), F.col("domain"), normalise))


def first_copies(df: DataFrame, time_col: str = "sent_at", late: str = "1 hour") -> DataFrame:
    """Each message of a domain once within the watermark; state older than `late` is dropped."""
    keyed = df.withColumn("key", T.dedup_key(F.col("text")))
    return keyed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["domain", "key"])


def flag_rates(df: DataFrame, flag: Column, time_col: str = "sent_at", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, domain, n, flagged) over tumbling windows, late rows within the watermark counted."""
    return df.withWatermark(time_col, late).groupBy(F.window(time_col, width), "domain").agg(F.count(F.lit(1)).alias("n"), F.sum(flag.cast("bigint")).alias("flagged"))


def sessions(df: DataFrame, key: str = "user_id", time_col: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return df.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), key).agg(F.count(F.lit(1)).alias("n"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """What has arrived, once; the next run goes on from the checkpoint."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path).awaitTermination()
