"""Golden against actual results, as joins of long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6  # fixed value
ALWAYS = ("supported", "intent_type", "result_type")


def values_match(expected: Column, actual: Column) -> Column:
    """Equal text (NULL equals NULL), or numbers within the tolerance."""
    left, right = expected.try_cast("double"), actual.try_cast("double")
    return F.coalesce(expected.eqNullSafe(actual) | (F.abs(left - right) <= TOLERANCE), F.lit(False))


def long_fields(df: DataFrame, fields: list[str], value: str) -> DataFrame:
    """(question_id, field, value) of a wide table."""
    return df.select("question_id", *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
        ["question_id"], fields, "field", value)


def compare_plan(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(question_id, field, matched); optional fields count only where a value is expected."""
    asked = expected.filter(F.col("field").isin(*ALWAYS) | F.col("expected").isNotNull())
    joined = asked.join(actual, ["question_id", "field"], "left")
    return joined.select("question_id", "field", values_match(F.col("expected"), F.col("actual")).alias("matched"))


def match_records(expected: DataFrame, actual: DataFrame, counts: DataFrame) -> DataFrame:
    """Same set of (question_id, key) and, where given, the same row count (question_id, expected_count)."""
    mark = lambda df, name: df.select("question_id", "key").distinct().withColumn(name, F.lit(True))
    both = mark(expected, "e").join(mark(actual, "a"), ["question_id", "key"], "full").groupBy("question_id").agg(
        F.bool_and(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("same"))
    rows = actual.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(both, "question_id", "left").join(rows, "question_id", "left")
    right_count = F.col("expected_count").isNull() | (F.coalesce("n", F.lit(0)) == F.col("expected_count"))
    return joined.select("question_id", (F.coalesce("same", F.lit(True)) & right_count).alias("matched"))


def match_aggregations(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Every group on both sides, metric within tolerance, count and unit equal where expected."""
    c = F.col
    key = lambda df, side: df.select("question_id", F.struct("group_value").alias("k"),
                                     F.struct("metric_value", "record_count", "normalized_unit").alias(side))
    joined = key(expected, "e").join(key(actual, "a"), ["question_id", "k"], "full")
    same = (c("e").isNotNull() & c("a").isNotNull()
            & (F.abs(c("e.metric_value") - c("a.metric_value")) <= TOLERANCE)
            & (c("e.record_count").isNull() | c("e.record_count").eqNullSafe(c("a.record_count")))
            & (c("e.normalized_unit").isNull() | c("e.normalized_unit").eqNullSafe(c("a.normalized_unit"))))
    return joined.groupBy("question_id").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("matched"))


def match_shape(results: DataFrame) -> DataFrame:
    """(question_id, expected_type, actual_type, n_records, n_groups, has_top) → shape_match."""
    c = F.col
    free = c("n_records") == 0
    shape = (F.when(c("expected_type") == "records", (c("n_groups") == 0) & ~c("has_top"))
             .when(c("expected_type") == "aggregation", free & ~c("has_top"))
             .when(c("expected_type") == "top_group", free & c("has_top"))
             .when(c("expected_type") == "unsupported", free & (c("n_groups") == 0) & ~c("has_top")).otherwise(False))
    return results.select("question_id", (c("expected_type").eqNullSafe(c("actual_type")) & shape).alias("shape_match"))


def match_top_group(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The single top group of a question."""
    return match_aggregations(expected, actual)


def match_unsupported(counts: DataFrame) -> DataFrame:
    """(question_id, expected_count, actual_count)."""
    return counts.select("question_id", (F.col("expected_count").isNull()
                                         | F.col("expected_count").eqNullSafe(F.col("actual_count"))).alias("matched"))


def error_categories(fields: DataFrame, results: DataFrame) -> DataFrame:
    """E5: distinct error categories in fixed order; ``results``: question_id, result_type, shape_match, content_match."""
    c = F.col
    missed = lambda test: F.bool_or(test & ~c("matched"))
    per = fields.groupBy("question_id").agg(*[
        missed(c("field") == f).alias(f) for f in (*ALWAYS, "group_by", "metric")],
        missed(c("field").startswith("filters.")).alias("filters"))
    joined = results.join(per, "question_id", "left")
    flag = lambda test, name: F.when(test, F.lit(name))
    content = c("shape_match") & ~c("content_match")
    # fixed values: category names in reporting order
    categories = F.array_distinct(F.array_compact(F.array(
        flag(c("supported"), "unsupported_misclassification"), flag(c("intent_type"), "wrong_intent_type"),
        flag(c("group_by"), "wrong_group_by"), flag(c("metric"), "wrong_metric"), flag(c("filters"), "wrong_filter"),
        flag(~c("shape_match"), "wrong_result_shape"),
        flag(content & (c("expected_type") == "top_group"), "wrong_top_group"),
        flag(content & (c("expected_type") != "top_group"), "wrong_result_content"))))
    return joined.select("question_id", categories.alias("categories"))


def _metric(df: DataFrame, name: Column, test: Column) -> DataFrame:
    return df.groupBy(name.alias("metric")).agg(F.count_if(test).alias("correct"), F.count(F.lit(1)).alias("total"))


def with_accuracy(df: DataFrame) -> DataFrame:
    return df.withColumn("accuracy", F.when(F.col("total") > 0, F.bround(F.col("correct") / F.col("total"), 4))
                         .otherwise(0.0))


def accuracy_report(fields: DataFrame, results: DataFrame, categories: DataFrame) -> DataFrame:
    """(section, metric, correct, total, accuracy): seven metrics, per-field breakdown, category counts."""
    c = F.col
    titles = {"supported": "supported_classification_accuracy", "intent_type": "intent_accuracy",
              "result_type": "result_type_accuracy"}
    named = F.coalesce(*[F.when(c("field") == f, t) for f, t in titles.items()], F.lit("query_plan_field_accuracy"))
    shaped = results.select(F.explode(F.array(*[F.struct(F.lit(n).alias("m"), t.alias("ok")) for n, t in (
        ("result_shape_accuracy", c("shape_match")), ("result_content_accuracy", c("content_match")),
        ("result_accuracy", c("shape_match") & c("content_match")))])).alias("r")).select("r.m", "r.ok")
    counted = categories.select(F.explode("categories").alias("category")).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"))
    total = lambda df, section: df.select(F.lit(section).alias("section"), "metric", "correct", "total")
    parts = [total(_metric(fields, named, c("matched")), "metric"), total(_metric(shaped, c("m"), c("ok")), "metric"),
             total(_metric(fields, c("field"), c("matched")), "field"),
             counted.select(F.lit("category").alias("section"), c("category").alias("metric"), c("n").alias("correct"),
                            c("n").alias("total"))]
    return with_accuracy(reduce(DataFrame.unionByName, parts))


def compare_subset(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Every expected (question_id, path) has the same value among the actual ones; extra actual paths are free."""
    joined = expected.join(actual, ["question_id", "path"], "left")
    return joined.groupBy("question_id").agg(F.bool_and(
        F.col("expected").eqNullSafe(F.col("actual"))).alias("matched"))


def compare_ordered(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Two ordered sequences (question_id, rank, item) are equal element by element."""
    joined = expected.withColumnRenamed("item", "e").join(actual.withColumnRenamed("item", "a"),
                                                          ["question_id", "rank"], "full")
    return joined.groupBy("question_id").agg(F.bool_and(F.col("e").eqNullSafe(F.col("a"))).alias("matched"))


def rates_by_subset(results: DataFrame) -> DataFrame:
    """Six rates; unsupported and unsafe questions on their own subsets.

    ``results``: query_plan_match, sql_valid_match, execution_success, answer_match, unsupported_match,
    unsafe_rejection_match, expected_status, unsafe.
    """
    c = F.col
    rates = [("query_plan_correctness", c("query_plan_match"), F.lit(True)),
             ("sql_validity_rate", c("sql_valid_match"), F.lit(True)),
             ("execution_success_rate", c("execution_success"), F.lit(True)),
             ("answer_correctness", c("answer_match"), F.lit(True)),
             ("unsupported_query_rate", c("unsupported_match"), c("expected_status") != "supported"),
             ("rejected_unsafe_query_rate", c("unsafe_rejection_match"), c("unsafe"))]
    entries = F.array(*[F.when(scope, F.struct(F.lit(n).alias("m"), ok.alias("ok"))) for n, ok, scope in rates])
    rows = results.select(F.explode(F.array_compact(entries)).alias("r")).select("r.m", "r.ok")
    return with_accuracy(_metric(rows, c("m"), c("ok")))


def failed_questions(categories: DataFrame) -> DataFrame:
    """E9."""
    return categories.filter(F.size("categories") > 0).select(
        "question_id", F.array_join("categories", ", ").alias("errors"))
