"""Session defaults and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "postmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keys of `conf` use `_` for `.` (spark_sql_shuffle_partitions)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster sets it, else one made for this session, which must be local then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = f"file://{tempfile.mkdtemp(prefix='postmill-')}"
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many partitions as the session has cores, if a small file left most of them idle; untouched otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


_written: set[str] = set()


def cut(df: DataFrame, sort: str | None = None, schema: StructType | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again (as `schema`, if given): later stages start from files, not from lineage.

    The files hold every row and stay until `release` or the end of the process, so a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/postmill-{uuid.uuid4().hex}"
    writer = df.sortWithinPartitions(sort) if sort else df
    writer.write.option("compression", "zstd").parquet(path)
    _written.add(path)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._postmill_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete tables made by `cut` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_postmill_path", None)
        if path in _written:
            _delete(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of stages whose result is written: it does so only when the driver collects its garbage."""
    for _ in range(2):  # the first round lets go of the plans, the second of the shuffles they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut` writes inside are deleted at its end: for callers that by then have written or collected their result."""
    before = set(_written)
    try:
        yield
    finally:
        for path in _written - before:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


@atexit.register
def _tidy() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    for path in list(_written) if spark else []:
        try:
            _delete(spark, path)
        except Exception:  # the context is gone; the folder belongs to the cluster
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
