"""The tall cells relation: one row per non-missing cell of any sheet.

cells: artifact_id, sheet_index, row_idx, col_idx (0-based), kind (str, num, date, bool), text
sheets: artifact_id, sheet_index, sheet_name, row_count, max_column_count
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid.functions.values import is_missing

SHEET = ["artifact_id", "sheet_index"]


def present(cells: DataFrame) -> DataFrame:
    """F1 on the relation: blank strings are not cells."""
    return cells.filter(~((F.col("kind") == "str") & is_missing(F.col("text"))) & F.col("text").isNotNull())


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that no task gets whole. The planner judges exploded rows by the size of what they were exploded from, so
    a thousand cells of one small row look small enough to be sent to the driver and from there to every task."""
    return df.hint("merge")


def expand_merged(cells: DataFrame, sheets: DataFrame, merged: DataFrame) -> DataFrame:
    """The top-left value over every merged rectangle, clipped to the sheet; the last range wins.

    ``merged``: artifact_id, sheet_index, ord, row_start, row_end, col_start, col_end (0-based, ends exclusive).
    """
    c = F.col
    clipped = (merged.join(sheets.select(*SHEET, "row_count", "max_column_count"), SHEET)
               .withColumn("row_end", F.least("row_end", "row_count"))
               .withColumn("col_end", F.least("col_end", "max_column_count"))
               .filter((c("row_start") < c("row_end")) & (c("col_start") < c("col_end"))))
    rows = clipped.withColumn("row_idx", F.explode(F.sequence("row_start", c("row_end") - 1)))
    covered = (rows.withColumn("col_idx", F.explode(F.sequence("col_start", c("col_end") - 1)))
               .groupBy(*SHEET, "row_idx", "col_idx")
               .agg(F.max_by(F.struct("row_start", "col_start"), "ord").alias("corner")))
    corners = cells.select(*SHEET, c("row_idx").alias("corner_row"), c("col_idx").alias("corner_col"), "kind", "text")
    filled = (covered.select(*SHEET, "row_idx", "col_idx", c("corner.row_start").alias("corner_row"),
                             c("corner.col_start").alias("corner_col"))
              .join(corners, [*SHEET, "corner_row", "corner_col"])
              .select(*SHEET, c("row_idx").cast("long"), c("col_idx").cast("int"), "kind", "text"))
    kept = cells.join(covered, [*SHEET, "row_idx", "col_idx"], "left_anti")
    return kept.select(*SHEET, "row_idx", "col_idx", "kind", "text").unionByName(filled)


def sheet_manifest(sheets: DataFrame, cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sheet extents with non-empty cell and detected block counts."""
    filled = present(cells).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("non_empty_cell_count"))
    found = blocks.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("detected_block_count"))
    return (sheets.join(filled, SHEET, "left").join(found, SHEET, "left")
            .fillna(0, ["non_empty_cell_count", "detected_block_count"]))


def parse_warnings(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """``empty_sheet`` or ``no_blocks_detected`` per sheet."""
    warning = (F.when(F.col("row_count") == 0, F.concat(F.lit("empty_sheet:"), F.col("sheet_name")))
               .when(F.col("detected_block_count") == 0, F.concat(F.lit("no_blocks_detected:"), F.col("sheet_name"))))
    return (sheets.select(*keys, "sheet_index", warning.alias("warning")).filter(F.col("warning").isNotNull()))
