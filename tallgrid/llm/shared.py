"""Tables in the folder that all executors share, and settings of the operators in this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrid.session import ensure_checkpoint_dir

LAST_ID = 2**63 - 1


def prepare(spark: SparkSession) -> None:
    """Shuffle files go when the execution that wrote them ends: the steps hand on tables, not shuffles."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(rows: int, spark: SparkSession, each: int = 8192) -> int:
    """Tasks that a table of so many small rows deserves: one for ``each`` rows, at most the shuffle partitions."""
    return max(1, min(partitions(spark), -(-rows // each)))


def keep(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """``df`` written to a new Parquet table of the shared folder, by at most ``tasks`` tasks, and read back."""
    return keep_at(df, tasks)[0]


def keep_at(df: DataFrame, tasks: int | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    if tasks:
        df = df.coalesce(tasks)
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def order_id(name: str) -> Column:
    """The id as a long that decides which document comes first; a null id comes after all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def in_training(name: str) -> Column:
    """True for rows that may teach a model: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 4 != 2
