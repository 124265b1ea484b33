"""Tables of the layered store: sessions, audit log, staging and harmonised observations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.session import finely_dealt


def promote(staging: DataFrame) -> DataFrame:
    """Staging rows with a usable variable."""
    return staging.filter(F.length(F.trim("variable")) > 0)


def rebuild_partition(observations: DataFrame, path: str, uploads: list[str] | None = None,
                      finish: Callable[[DataFrame], DataFrame] = lambda rows: rows, dealt: bool = False) -> None:
    """Replace the partitions of the uploads in ``observations``; other uploads stay. Safe to repeat.

    ``uploads`` names all uploads of this commit: those that yield no rows any more are cleared. Rows are rebalanced by
    upload, so Spark splits a large upload over as many tasks as its size asks for. ``finish`` adds columns that follow from
    the row alone, after the rows moved and were sorted. Rows of a handful of uploads may be ``dealt`` already: they stay in their
    tasks, each of which writes one file per upload.
    """
    with finely_dealt(observations.sparkSession, dealt):
        rows = observations if dealt else observations.hint("rebalance", "upload_session_id")
        (finish(rows.sortWithinPartitions("upload_session_id", "variable", "observation_date"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("upload_session_id").parquet(path))
    if uploads:
        clear_uploads(observations, path, uploads)


def clear_uploads(observations: DataFrame, path: str, uploads: list[str]) -> None:
    """Remove the partitions of those ``uploads`` that have no row in ``observations``."""
    spark = observations.sparkSession
    kept = {r[0] for r in observations.filter(F.col("upload_session_id").isin(uploads))
            .select("upload_session_id").distinct().collect()}  # at most the named uploads
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    named = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for upload in set(uploads) - kept:  # the named folders alone; the table may hold any number of others
        files.delete(jvm.org.apache.hadoop.fs.Path(folder, named.getPartitionPathString("upload_session_id", upload)), True)


def list_sessions(sessions: DataFrame, artifacts: DataFrame, limit: int = 50) -> DataFrame:
    """Sessions with their artifact facts, newest first."""
    catalog.check_limit(limit, catalog.SESSION_LIMIT_MAX)
    joined = sessions.join(artifacts, "artifact_id", "left")
    return (joined.withColumn("sheet_count", F.coalesce(F.size("sheet_manifest"), F.lit(0)))
            .withColumn("sheet_count", F.greatest("sheet_count", F.lit(0))).drop("sheet_manifest")
            .orderBy(F.coalesce("uploaded_at", "created_at").desc(), "session_id")
            .limit(limit))


def session_detail(sessions: DataFrame, artifacts: DataFrame, session_id: str) -> DataFrame:
    """S12."""
    return sessions.filter(F.col("session_id") == session_id).join(artifacts, "artifact_id", "left")


def current_status(events: DataFrame) -> DataFrame:
    """Latest status per upload from appended (session_id, seq, status, commit_error) events."""
    latest = F.max_by(F.struct("status", "commit_error"), "seq")
    return events.groupBy("session_id").agg(latest.alias("s")).select("session_id", "s.status", "s.commit_error")


def append_status(events: DataFrame, path: str) -> None:
    """Append ``preview_ready``, ``committed`` or ``failed`` events."""
    events.write.mode("append").parquet(path)


def with_fingerprint(entries: DataFrame, statement: str = "statement") -> DataFrame:
    """The fingerprint stored with every audited statement."""
    return entries.withColumn("sql_fingerprint", F.sha2(F.col(statement), 256))


def append_audit(entries: DataFrame, path: str) -> None:
    """S14."""
    entries.write.mode("append").parquet(path)


def tail_audit(log: DataFrame, correlation_id: str | None = None,
               limit: int = catalog.AUDIT_LIMIT_DEFAULT) -> DataFrame:
    """Newest entries first."""
    catalog.check_limit(limit, catalog.AUDIT_LIMIT_MAX)
    rows = log if not correlation_id else log.filter(F.col("correlation_id") == correlation_id)
    return rows.orderBy(F.col("id").desc()).limit(limit)


def _broken(df: DataFrame, rule: str, key: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.alias("key"))


def check_constraints(observations: DataFrame, artifacts: DataFrame, sessions: DataFrame) -> DataFrame:
    """(rule, key) of every broken constraint. The key count is a partial aggregate on the primary key."""
    c = F.col
    key = F.concat_ws("|", *catalog.OBSERVATION_KEY)
    repeated = (observations.groupBy(*catalog.OBSERVATION_KEY).agg(F.count(F.lit(1)).alias("n"))
                .filter(c("n") > 1))
    orphans = observations.select("upload_session_id").distinct().join(
        sessions.select(c("session_id").alias("upload_session_id")), "upload_session_id", "left_anti")
    parts = [
        _broken(repeated, "primary_key", key),
        _broken(observations.filter(c("source_row_index") <= 0), "row_index_positive", key),
        _broken(observations.filter(F.coalesce(F.length(F.trim("variable")), F.lit(0)) == 0), "variable_present", key),
        _broken(artifacts.filter(F.length("file_hash_sha256") != 64), "hash_length", c("artifact_id")),
        _broken(artifacts.filter(c("file_size_bytes") < 0), "size_not_negative", c("artifact_id")),
        _broken(orphans, "known_session", c("upload_session_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def backfill_legacy(observations: DataFrame) -> DataFrame:
    """Rows of older layouts: dimensions from the map, normalised := source, default status and flags."""
    c = F.col
    out = observations.withColumns({
        name: F.coalesce(c(name), c("dimensions_json")[name]) for name in catalog.REQUIRED_DIMENSIONS})
    return out.withColumns({
        "normalized_value": F.coalesce("normalized_value", "value"),
        "normalized_unit": F.coalesce("normalized_unit", "unit"),
        "validation_status": F.coalesce(F.nullif(F.trim("validation_status"), F.lit("")), F.lit("valid")),
        "quality_flags": F.coalesce("quality_flags", F.array().cast("array<string>")),
    })
