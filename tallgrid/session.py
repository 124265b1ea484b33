"""Session settings the library relies on, and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # compressed files are larger in memory: judge broadcast sides by that size
    "spark.sql.sources.fileCompressionFactor": "3.0",
}


def build_session(master: str | None = None, app: str = "tallgrid", **extra: str) -> SparkSession:
    """A session with the library's settings; on a cluster leave ``master`` unset."""
    # checkpoint files go when nothing refers to them any more
    builder = SparkSession.builder.appName(app).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Set the run-time settings on a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


# up to this number of shuffle partitions the tasks write each apart and hold no rows back in memory
FINE = 200
HASHED = {  # a side of at most this size per partition is hashed, so the other side is not sorted
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB"}


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def finely_dealt(spark: SparkSession, reads: bool = False) -> AbstractContextManager[None]:
    """For one run over wide rows: shuffles are dealt into ``FINE`` partitions at least, and small sides of joins are hashed, so that
    sorts fit the memory of a task and spill nothing. The adaptive planner puts small partitions together again. With ``reads`` rows
    may be sorted in the task that read them, so files are read in small pieces as well."""
    return _set(spark, {"spark.sql.adaptive.coalescePartitions.initialPartitionNum":
                        str(max(FINE, int(spark.conf.get("spark.sql.shuffle.partitions")))), **HASHED,
                        **({"spark.sql.files.maxPartitionBytes": "16MB"} if reads else {})})


def without_shuffle_files(spark: SparkSession) -> AbstractContextManager[None]:
    """For one run whose result is a table: its shuffle files go when it ends, so they never stand beside those of a later step."""
    return _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: what the cluster names; on one machine, where none is named, a fresh local one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise an iteration's result in the reliable checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


LOOKUP_ROWS = 20_000


def lookup(df: DataFrame) -> DataFrame:
    """A table that far more rows look up: materialised, and sent to every task where it has few rows.

    The adaptive planner leaves a table of a handful of keys to a sort-merge join, where all rows meet in as many tasks as there
    are keys.
    """
    held = cut(df)
    return F.broadcast(held) if held.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else held
