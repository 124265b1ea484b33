"""Queries on observations that no commit judged give what the judged ones give, and write no table of observations."""

import pytest
from pyspark.sql import functions as F

from tallgrid.operators import quality, queries as q
from tallgrid.operators import questions as nq
from tallgrid.plans import batch
from tallgrid.registry import asking, read_queries, retrieving, tables

SF = "/root/testdata/sf0.001"
QUESTIONS = ["count valid records by treatment", "how many records by status", "count warning yield by variety", "average valid yield by location",
             "show valid yield records", "show warning records for R", "show valid and warning moisture records from 2000", "list invalid records"]

UNCOMMITTED = (
    (retrieving, ("r01_available_values", "r08_context_summary", "r08_scope_sections", "r10_explain_metadata", "a03_context_body")),
    (read_queries, ("q07_count_by_status", "q11_plan_filters")),
    (asking, ("n12_execute_aggregates_a", "n12_execute_aggregates_b", "n12_execute_lists_b", "a01_record_findings", "a02_quality_notes")))


@pytest.fixture(scope="module")
def rows(spark):
    """Observations of which a third comes twice and some three times, the copies without a value, out of range or in another row."""
    raw = tables.raw_observations(spark, SF)
    again = raw.filter("source_row_index % 3 = 0").withColumns({
        "value": F.when(F.col("source_row_index") % 2 == 0, F.col("value")), "source_row_index": F.col("source_row_index") + 10**6})
    wild = raw.filter("source_row_index % 7 = 0").withColumns({"value": F.lit(10.0**6), "source_row_index": F.col("source_row_index") + 10**7})
    return quality.normalise_observation(raw.unionByName(again).unionByName(wild)).cache()


@pytest.fixture(scope="module")
def judged(rows):
    return quality.validate(rows).cache()


def _texts(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _plans(spark, rows, rules):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(QUESTIONS)], "question_id long, question string")
    asked = asking.asked(spark, SF).limit(40).unionByName(more)
    tag, plan = {"a": (nq.tag_a, batch.plan_a), "b": (nq.tag_b, batch.plan_b)}[rules]
    return plan(tag(asked, q.distinct_values(rows, nq.VALUE_FIELDS))).cache()


def test_sums_by_key_equal_those_of_judged_rows(rows, judged):
    by = ["treatment", "variable", "validation_status", "normalized_unit"]
    of = [F.sum("n").alias("n"), F.sum("v").alias("v"), F.round(F.sum("s"), 1).alias("s")]
    wanted = judged.withColumns({"n": F.lit(1), "v": F.col("normalized_value").isNotNull().cast("int"), "s": F.col("normalized_value")})
    sums = quality.status_sums(rows, ["treatment"]).withColumnsRenamed({"n_value": "v", "s_value": "s"})
    assert _texts(sums.groupBy(*by).agg(*of)) == _texts(wanted.groupBy(*by).agg(*of))
    assert judged.groupBy("validation_status").count().count() == 3
    assert _texts(q.count_by_status(rows)) == _texts(q.aggregate(judged, "validation_status", "count"))
    # who tells nobody valid from warning counts nothing by key
    plan = quality.status_sums(rows, [], duplicates=False).groupBy((F.col("validation_status") == "invalid").alias("bad")).agg(F.sum("n").alias("n"))
    assert _texts(plan) == _texts(judged.groupBy((F.col("validation_status") == "invalid").alias("bad")).agg(F.count(F.lit(1)).alias("n")))
    assert "xxhash64" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_the_duplicate_key_come_before_the_count(rows, judged):
    filters = [("variety", "ilike", "brand#1"), ("validation_status", "in", ["warning", "valid"]), ("observation_date", "gte", "1996-01-01"),
               ("normalized_unit", "eq", "kg/ha")]
    found = q.judged_where(rows, filters)
    assert _texts(q.safe_view(found)) == _texts(q.apply_plan_filters(q.safe_view(judged), filters)) and found.count() > 50
    counted = found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]
    assert "Brand#1" in counted or "brand#1" in counted.lower()


@pytest.mark.parametrize("rules, few", [("a", True), ("b", True), ("b", False)])
def test_plans_on_rows_that_are_not_judged(spark, rows, judged, rules, few, monkeypatch):
    if not few:
        monkeypatch.setattr(batch, "LOOKUP_ROWS", 0)
    plans = _plans(spark, rows, rules)
    rounded = lambda df: df.withColumn("metric_value", F.round("metric_value", 6))
    want = _texts(rounded(batch.execute_aggregates(plans, judged)))
    assert want and _texts(rounded(batch.execute_aggregates(plans, rows, judged=False))) == want
    want = batch.execute_lists(plans, judged)
    found = batch.execute_lists(plans, rows, judged=False)
    assert found.columns == want.columns and _texts(found) == _texts(want)
    statuses = {r[0] for r in want.select("validation_status").distinct().collect()}
    assert statuses == {"valid", "warning", "invalid"}


@pytest.mark.parametrize("module, name", [(m, n) for m, names in UNCOMMITTED for n in names])
def test_queries_that_need_no_commit_make_none(spark, module, name, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("observations were committed")
    monkeypatch.setattr(tables.store, "rebuild_partition", refuse)
    monkeypatch.setattr(tables, "_committed", {k: v for k, v in tables._committed.items() if k[0] == "raw"})
    assert module.QUERIES[name][0](spark, SF).count() > 0


def test_a_commit_moves_no_row_for_its_upload(spark, monkeypatch):
    monkeypatch.setattr(tables, "_committed", {})
    raw = tables.raw_observations(spark, SF)

    def refuse(*_):
        raise AssertionError("rows were moved")
    monkeypatch.setattr(type(raw), "hint", refuse)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    written = tables.observations(spark, SF)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    expected = tables.validated(spark, SF)
    assert _texts(written) == _texts(expected) and written.select("upload_session_id").distinct().count() == 7
