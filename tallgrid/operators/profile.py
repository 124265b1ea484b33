"""Profiles and inferred meaning of block columns.

``values`` holds one row per non-missing cell of the data region: artifact_id, block_id, col_pos, row_no (1-based,
after empty rows were dropped), kind (str, num, date, bool) and text. ``columns`` holds one row per column with its
header, ``blocks`` one row per block with n_rows and inferred_unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions import units
from tallgrid.functions import values as v
from tallgrid.operators import semantics
from tallgrid.sources.cells import unsent

BLOCK = ["artifact_id", "block_id"]
COLUMN = [*BLOCK, "col_pos"]


SKETCH_BITS = 8  # 256 words, far above the distinct words that a threshold asks about


def cell_is_numeric(kind: Column, text: Column) -> Column:
    return (kind == "num") | ((kind == "str") & v.is_numeric(text))


def cell_date(kind: Column, text: Column) -> Column:
    return F.when(kind == "date", F.substring(text, 1, 10).try_cast("date")).when(kind == "str", v.parse_date(text))


def cell_number(kind: Column, text: Column) -> Column:
    return F.when(kind == "num", text.try_cast("double")).when(kind == "str", v.to_numeric(text))


def column_aggregates(values: DataFrame) -> DataFrame:
    """One pass over all values; every measure is a partial aggregate.

    ``n_distinct`` comes from a sketch that keeps 2 ** ``SKETCH_BITS`` words a column: exact below that number, which is all
    that a threshold of ``REPEATED_DISTINCT`` words needs.
    """
    c = F.col
    marked = values.select(
        *COLUMN, "row_no", "kind", "text",
        cell_is_numeric(c("kind"), c("text")).alias("is_num"),
        cell_date(c("kind"), c("text")).isNotNull().alias("is_date"),
        F.when(c("kind") == "str", v.strip(c("text"))).alias("word"))
    textual = c("word").isNotNull() & ~c("is_num")
    short = textual & ~c("word").contains(" ") & (F.length("word") <= catalog.GENERIC_DIM_LENGTH)
    return marked.groupBy(*COLUMN).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(c("is_num")).alias("n_num"),
        F.count_if(c("is_date")).alias("n_date"),
        F.count("word").alias("n_str"),
        F.count_if(textual).alias("n_text"),
        F.count_if(short).alias("n_short"),
        F.theta_sketch_estimate(F.theta_sketch_agg(F.concat(F.lit("="), F.lower("word")), F.lit(SKETCH_BITS))).alias("n_distinct"),
        *[e.alias(name) for name, e in semantics.label_aggregates(c("text")).items()])


def suggested_type() -> Column:
    """T10, decided on all values of the column."""
    c = F.col
    return (F.when(c("n") == 0, "text")
            .when(c("n_num") / c("n") >= catalog.NUMERIC_SHARE, "numeric")
            .when(c("n_date") / c("n") >= catalog.DATE_SHARE, "date")
            .otherwise("text"))


def generic_dimension() -> Column:
    """Short tokens or few repeated texts in a dense, unnamed text column."""
    c = F.col
    unnamed = ((c("suggested") == "text") & c("column").startswith(catalog.GENERIC_PREFIX)
               & (c("missing_ratio") <= catalog.GENERIC_DIM_MISSING))
    short = (c("n") >= 3) & (c("n_short") / c("n") >= catalog.GENERIC_DIM_SHORT)
    repeated = ((c("n_str") >= 3) & c("n_distinct").between(2, catalog.REPEATED_DISTINCT)
                & (c("n_distinct") / c("n_str") <= catalog.REPEATED_SHARE))
    return unnamed & (short | repeated)


def date_issues(values: DataFrame, typed: DataFrame, examples: int = catalog.MAX_DATE_EXAMPLES) -> DataFrame:
    """The first ``examples`` distinct unparseable texts of each date column, in order of appearance."""
    dated = typed.filter(F.col("suggested") == "date").select(*COLUMN)
    bad = (unsent(values).join(dated, COLUMN)
           .filter(cell_date(F.col("kind"), F.col("text")).isNull())
           .groupBy(*COLUMN, "text").agg(F.min("row_no").alias("row_no")))
    order = Window.partitionBy(*COLUMN).orderBy("row_no")
    return (bad.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= examples)
            .groupBy(*COLUMN)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"])
                 .alias("example_values")))


def profile_columns(values: DataFrame, columns: DataFrame, blocks: DataFrame) -> DataFrame:
    """Type, missing share, warnings, role, canonical names and unit of every column."""
    c = F.col
    measured = (columns.select(*COLUMN, "column")
                .join(blocks.select(*BLOCK, "n_rows", "inferred_unit"), BLOCK)
                .join(column_aggregates(values), COLUMN, "left"))
    counts = ("n", "n_num", "n_date", "n_str", "n_text", "n_short", "n_distinct",
              "n_numbered")
    filled = measured.fillna(0, list(counts)).fillna(False, ["all_roman", "any_treatment", "any_variety"])
    typed = (filled.withColumn("suggested", suggested_type())
             .withColumn("missing", c("n_rows") - c("n"))
             .withColumn("missing_ratio",
                         F.when(c("n_rows") > 0, F.bround(c("missing") / c("n_rows"), 3)).otherwise(0.0)))
    issues = date_issues(values, typed)
    known = (typed.join(issues, COLUMN, "left")
             .withColumn("like_dimension", generic_dimension())
             .withColumn("dimension", F.coalesce(
                 semantics.header_dimension(c("column")),
                 semantics.value_dimension(c("n"), c("all_roman"), c("any_treatment"), c("any_variety"),
                                           c("n_numbered")))))
    annotation = (c("column").startswith(catalog.GENERIC_PREFIX) & (c("suggested") == "text")
                  & ~c("like_dimension") & c("dimension").isNull())
    flag = lambda condition, name: F.when(condition, F.lit(name))
    warned = known.withColumn("warnings", F.array_compact(F.array(
        flag(c("missing_ratio") >= catalog.HIGH_MISSING, "high_missing"),
        flag(annotation, "annotation_like"),
        flag(c("example_values").isNotNull(), "date_parse_issue"),
        flag((c("suggested") == "text") & (c("n") > 0)
             & (F.greatest("n_num", "n_date") / c("n") >= catalog.AMBIGUOUS_SHARE), "ambiguous_type"))))
    role = (F.when(c("dimension").isNotNull() & (c("suggested") == "text"), "dimension")
            .when(c("like_dimension"), "dimension")
            .otherwise(semantics.semantic_role(c("column"), c("suggested"),
                                               F.array_contains("warnings", "annotation_like"))))
    named = warned.withColumn("semantic_role", role).withColumn(
        "canonical_measure", F.when(c("semantic_role") == "measure", F.coalesce(
            semantics.header_measure(c("column")), units.lookup(c("inferred_unit"), catalog.MEASURE_OF_UNIT))))
    unit = F.coalesce(
        units.infer_unit(c("column"), c("canonical_measure")),
        F.when(units.is_supported(c("canonical_measure"), c("inferred_unit")), c("inferred_unit")))
    return named.select(
        *COLUMN, "column", "suggested", F.lit(None).cast("string").alias("type_override"), "semantic_role",
        "canonical_measure", F.when(c("semantic_role") == "dimension", c("dimension")).alias("canonical_dimension"),
        unit.alias("unit"), "warnings", "missing", c("n_rows").alias("total"), "missing_ratio", "example_values")


def classify_blocks(columns: DataFrame) -> DataFrame:
    """observation_like, summary_like (skipped) or unknown, with the counts as reasons."""
    c = F.col
    measure = c("semantic_role") == "measure"
    dimension = c("semantic_role") == "dimension"
    weak = r"^[a-z]{1,3}$"  # fixed value: weak summary names
    counted = columns.groupBy(*BLOCK).agg(
        F.count_if(measure).alias("measures"),
        F.count_if(measure & c("canonical_measure").isNotNull()).alias("canonical_measures"),
        F.count_if(measure & c("unit").isNotNull()).alias("measure_units"),
        F.array_sort(F.collect_set(F.when(dimension, c("canonical_dimension")))).alias("dims"),
        F.count_if(measure & semantics.key_of(c("column")).rlike(weak)).alias("weak_names"))
    reason = lambda label, value: F.concat(F.lit(f"{label}="), value.cast("string"))
    observed = (c("measures") > 0) & (F.size("dims") > 0) & ((c("canonical_measures") > 0) | (c("measure_units") > 0))
    summary = ((c("measures") >= 3) & (F.size("dims") == 0) & (c("canonical_measures") == 0)
               & (c("measure_units") == 0) & (c("weak_names") >= F.greatest(F.lit(3), c("measures") - 1)))
    kind = F.when(observed, "observation_like").when(summary, "summary_like").otherwise("unknown")
    return counted.select(
        *BLOCK, kind.alias("semantic_classification"),
        F.array(reason("measure_columns", c("measures")), reason("canonical_measures", c("canonical_measures")),
                reason("measure_units", c("measure_units")),
                reason("canonical_dimensions", F.when(F.size("dims") > 0, F.array_join("dims", ",")).otherwise("none")),
                reason("weak_measure_names", c("weak_names"))).alias("classification_reasons"),
        F.when(kind == "summary_like", "skip_summary_block").otherwise("commit_observations").alias("commit_decision"),
        F.when(kind == "summary_like", "summary_like_block").alias("skip_reason"))


def preview_sample(values: DataFrame, rows: int = catalog.SAMPLE_ROWS) -> DataFrame:
    """The cells of the first rows of every block."""
    return values.filter(F.col("row_no") <= rows)


def records(values: DataFrame, columns: DataFrame) -> DataFrame:
    """one header-keyed map per data row; a repeated header keeps its last column."""
    named = values.join(columns.select(*COLUMN, "column"), COLUMN)
    entries = F.array_sort(F.collect_list(F.struct("col_pos", "column", "text")))
    return named.groupBy(*BLOCK, "row_no").agg(last_wins(entries, "column", "text").alias("record"))


def last_wins(entries: Column, key: str, value: str) -> Column:
    """A map from ordered (key, value) structs in which a later entry replaces an earlier one."""
    later = lambda x, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y[key] == x[key])
    kept = F.filter(entries, lambda x, i: ~later(x, i))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x[key], x[value])))
