"""Golden question files in, accuracy reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLAN = "struct<variable:string,group_by:string,metric:string,include_invalid:boolean,filters:map<string,string>>"
ITEM = "struct<group_value:string,metric_value:double,record_count:bigint,normalized_unit:string>"
GOLDEN_SCHEMA = ("id string, question string, expected_supported boolean, expected_intent_type string, "
                 f"expected_result_type string, expected_query_plan {PLAN}, expected_result struct<count:bigint,"
                 f"record_keys:array<string>,aggregation_items:array<{ITEM}>,top_group:{ITEM}>, notes string")


def load_golden(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Golden questions from JSON documents, or from (splittable) files of one question per line."""
    return spark.read.schema(GOLDEN_SCHEMA).option("multiLine", not one_per_line).json(path)


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    """Seed observations from JSON files."""
    schema = ("upload_session_id string, observation_date date, plot_id string, variety string, treatment string, "
              "location string, variable string, value double, unit string, normalized_value double, "
              "normalized_unit string, validation_status string, quality_flags array<string>, source_sheet string, "
              "source_row_index long, source_column string")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """The accuracy report as JSON lines."""
    report.write.mode("overwrite").json(path)
