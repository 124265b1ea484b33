"""From mapped block values to observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions import units
from tallgrid.functions import values as v
from tallgrid.operators import quality
from tallgrid.operators.profile import BLOCK, COLUMN, cell_date, cell_number, last_wins
from tallgrid.session import cut, lookup


def row_facts(values: DataFrame, columns: DataFrame) -> DataFrame:
    """H2, H3 inputs: per data row its date, ordered dimension entries and numeric measure cells.

    One shuffle on (block, row). A group is one spreadsheet row, so its lists are as long as the table is wide.
    """
    c = F.col
    first_date = (columns.filter(c("semantic_role") == "date").groupBy(*BLOCK)
                  .agg(F.min("col_pos").alias("date_pos")))
    roles = columns.select(*COLUMN, "column", "semantic_role", "canonical_dimension").join(first_date, BLOCK, "left")
    # the row key must survive even when all its cells sit in ignored columns, so nothing is filtered here
    joined = values.join(lookup(roles), COLUMN)
    dimension = c("semantic_role") == "dimension"
    return joined.groupBy(*BLOCK, "row_no").agg(
        F.max(F.when((c("semantic_role") == "date") & (c("col_pos") == c("date_pos")),
                     cell_date(c("kind"), c("text")))).alias("row_date"),
        F.min("sheet_row").alias("sheet_row"),
        F.array_sort(F.collect_list(F.when(dimension, F.struct(
            c("col_pos"), F.coalesce(v.allowed_or_null(c("canonical_dimension"), catalog.DIMENSIONS), c("column"))
            .alias("key"), c("text").alias("value"))))).alias("dims"),
        F.map_from_entries(F.collect_list(F.when(c("semantic_role") == "measure", F.struct(
            c("col_pos"), cell_number(c("kind"), c("text")))))).alias("numbers"))


def build_observations(values: DataFrame, columns: DataFrame, blocks: DataFrame) -> DataFrame:
    """H1-H6: one observation per data row and measure column of every committed block, NULL values included.

    ``blocks``: artifact_id, block_id, sheet_name, row_start, data_row_start, inferred_observation_date,
    year_override, commit_decision. ``values`` also carries sheet_row, the true 1-based sheet row.
    """
    c = F.col
    columns = cut(columns)
    # what a header says is worked out once per column, not once per row
    measure = v.allowed_or_null(c("canonical_measure"), catalog.MEASURES)
    meta = v.measure_column_meta(c("column"), measure)
    defaults = F.filter(F.array(F.struct(F.lit("raw_measure_name").alias("key"), c("column").alias("value")), *[
        F.struct(F.lit(name).alias("key"), meta[name].alias("value"))
        for name in ("meaning", "treatment", "replicate_column_code", "replicate")]), lambda e: e["value"].isNotNull())
    headed = F.struct(
        "col_pos", c("column").alias("source_column"), measure.alias("measure"), meta["treatment"].alias("treatment"),
        F.coalesce(measure, meta["meaning"], "column").alias("variable"), units.normalize_unit(c("unit")).alias("unit"),
        defaults.alias("defaults"))
    measures = columns.filter(c("semantic_role") == "measure").groupBy(*BLOCK).agg(
        F.array_sort(F.collect_list(headed)).alias("measures"))
    dated = columns.filter(c("semantic_role") == "date").select(*BLOCK, F.lit(True).alias("has_date")).distinct()
    context = (blocks.filter(c("commit_decision") != "skip_summary_block").join(measures, BLOCK)
               .join(dated, BLOCK, "left").select(
                   *BLOCK, "sheet_name", "row_start", "data_row_start", "measures",
                   F.coalesce("has_date", F.lit(False)).alias("has_date"),
                   F.coalesce("inferred_observation_date", F.when(
                       c("year_override").isNotNull(), F.make_date("year_override", F.lit(1), F.lit(1))))
                   .alias("fallback_date")))
    rows = row_facts(values, columns).withColumn("dims", last_wins(c("dims"), "key", "value")).join(lookup(context), BLOCK)
    spread = rows.select("*", F.explode("measures").alias("m")).drop("measures")
    absent = F.map_from_entries(F.filter("m.defaults", lambda e: ~F.map_contains_key(c("dims"), e["key"])))
    facts = spread.select(
        c("artifact_id").alias("upload_session_id"), "block_id", c("sheet_name").alias("source_sheet"),
        (c("row_start") + c("data_row_start") + c("row_no") - 1).cast("long").alias("source_row_index"),
        "sheet_row", "m.source_column", F.coalesce("row_date", "fallback_date").alias("observation_date"),
        c("dims")["plot_id"].alias("plot_id"), c("dims")["variety"].alias("variety"),
        F.coalesce(c("dims")["treatment"], "m.treatment").alias("treatment"), c("dims")["location"].alias("location"),
        "m.variable", c("numbers")[c("m.col_pos")].alias("value"), "m.unit", "m.measure",
        F.map_concat("dims", absent).alias("dimensions_json"), "has_date")
    normalised = quality.normalise_observation(facts, "measure").drop("measure")
    return normalised.withColumn("replicate", c("dimensions_json")["replicate"])


def validate_observations(observations: DataFrame) -> DataFrame:
    """H7-H10 on built observations: a date is required only where the block has a date column."""
    return quality.validate(observations, F.col("has_date")).drop("has_date")


def commit_summary(staging: DataFrame, harmonised: DataFrame) -> DataFrame:
    """Staging and harmonised row counts per upload."""
    count = lambda df, name: df.groupBy("upload_session_id").agg(F.count(F.lit(1)).alias(name))
    return count(staging, "staging_rows").join(count(harmonised, "harmonized_rows"), "upload_session_id", "left") \
        .fillna(0, ["harmonized_rows"])
