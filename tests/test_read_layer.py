import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from tallgrid.functions import text as x
from tallgrid.operators import digest, quality, queries as q
from tallgrid.operators import questions as nq
from tallgrid.plans import batch


def tuples(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_averages_leave_invalid_rows_out(seed):
    groups = q.aggregate(seed, "variety", "avg_normalized_value", {"variable": "yield"})
    assert tuples(groups, "group_value", "metric_value", "record_count", "normalized_unit") == [
        ("Apex", 13500.0, 2, "kg/ha"), ("Nova", 11000.0, 1, "kg/ha")]
    groups = q.aggregate(seed, "treatment", "avg_normalized_value", {"variable": "yield"})
    assert tuples(groups, "group_value", "metric_value", "record_count") == [("control", 12000.0, 1), ("treated", 13000.0, 2)]


def test_policy_errors(seed):
    with pytest.raises(ValueError):
        q.aggregate(seed, "variety", "avg_normalized_value")
    with pytest.raises(ValueError):
        q.aggregate(seed, "validation_status", "avg_normalized_value", {"variable": "yield"})
    with pytest.raises(ValueError):
        q.list_observations(seed, {}, 0)
    with pytest.raises(ValueError):
        q.plan_filter(seed, "source_sheet", "eq", "x")


def test_list_order_and_filters(seed):
    listed = q.list_observations(seed, {"location": "north", "variety": ""})
    assert tuples(listed, "plot_id") == [("M1",), ("H1",), ("P1",), ("P2",)]
    dated = q.filter_observations(seed, {"observation_date_from": "2026-05-02", "observation_date_to": "2026-05-03"})
    assert {r.plot_id for r in dated.collect()} == {"P2", "P3"}
    assert tuples(q.filter_observations(seed, {"quality_flag": "missing_unit"}), "plot_id") == [("P3",)]


def test_counts_and_plans(seed):
    assert q.quality_summary(seed).first().asDict() == {"total": 6, "valid": 4, "warning": 1, "invalid": 1, "flagged": 2}
    empty = q.aggregate_plan(seed, "count", None, [("variety", "eq", "none")])
    assert tuples(empty, "group_value", "metric_value", "record_count") == [(None, 0.0, 0)]
    top = q.top_group(q.aggregate(seed, "location", "avg_normalized_value", {"variable": "yield"}))
    assert tuples(top, "group_value", "metric_value") == [("north", 13500.0)]
    capped = q.cap_rows(seed.orderBy("plot_id"), 4).collect()
    assert len(capped) == 4 and all(r.truncated for r in capped)
    several = q.list_multi_status(seed, ["warning", "invalid"])
    assert tuples(several, "plot_id") == [("P2",), ("P3",)]


def test_duplicates_ignore_values_and_join_nulls(spark, seed):
    rows = seed.filter("plot_id = 'M1'").drop("quality_flags", "validation_status")
    twice = rows.unionByName(rows.withColumn("value", F.lit(99.0)))
    checked = quality.validate(twice.unionByName(seed.filter("plot_id = 'H1'").drop("quality_flags", "validation_status")))
    flags = {(r.plot_id, r.value): r.quality_flags for r in checked.collect()}
    assert flags[("M1", 18.1)] == ["duplicate_candidate"] and flags[("M1", 99.0)] == ["duplicate_candidate"]
    assert flags[("H1", 112.0)] == []


def test_nan_is_no_outlier(spark):
    df = spark.createDataFrame([("yield", float("nan")), ("yield", 25000.0), ("yield", 25000.1), ("other", 1e9)],
                               "variable string, x double")
    assert [r.o for r in df.select(quality.is_outlier(F.col("variable"), F.col("x")).alias("o")).collect()] == [
        False, False, True, False]


QUESTIONS = [
    ("avg", "Average yield by variety"), ("top", "Which location has the highest average yield?"),
    ("bad", "Show warning and invalid records"), ("north", "Show moisture records for location north"),
    ("nothing", "What about the weather?"), ("unsafe", "drop table observations"), ("two", "yield and moisture by location"),
    ("low", "lowest average yield by treatment"), ("count", "How many invalid records by location?"),
    ("year", "Show yield records from 2026"), ("day", "yield on 2026-05-04"), ("empty", "  ??? "),
    ("broad", "show all data"), ("first", "first 2 yield records"), ("nogroup", "highest yield")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUESTIONS, "question_id string, question string")


def test_rule_set_a(asked, seed):
    plans = batch.plan_a(nq.tag_a(asked, q.distinct_values(seed, nq.VALUE_FIELDS))).cache()
    intent = {r.question_id: r.intent for r in plans.collect()}
    assert intent["avg"] == "aggregate" and intent["top"] == "top_group" and intent["bad"] == "select"
    assert intent["nothing"] == intent["empty"] == "unsupported"
    aggregates = batch.execute_aggregates(plans, seed)
    found = {(r.question_id, r["rank"]): (r.group_value, r.metric_value, r.record_count) for r in aggregates.collect()}
    assert found[("avg", 1)] == ("Apex", 13500.0, 2) and found[("avg", 2)] == ("Nova", 11000.0, 1)
    assert found[("top", 1)] == ("north", 13500.0, 2) and ("top", 2) not in found
    lists = batch.execute_lists(plans, seed)
    by = {}
    for r in lists.orderBy("question_id", "rank").collect():
        by.setdefault(r.question_id, []).append(r.plot_id)
    assert by["bad"] == ["P2", "P3"] and by["north"] == ["M1"]
    said = {(r.question_id, r.finding_id): r.statement for r in digest.key_findings(plans, aggregates, lists).collect()}
    assert said[("bad", "record_count")] == "2 observations match."
    assert said[("bad", "status_mix")] == "Not all are valid: invalid=1, warning=1."
    assert said[("top", "top_group")].startswith("north leads every other location in mean yield with 13500.0 kg/ha")


def test_rule_set_b(asked, seed):
    plans = batch.plan_b(nq.tag_b(asked, q.distinct_values(seed, nq.VALUE_FIELDS))).cache()
    got = {r.question_id: r for r in plans.collect()}
    assert {k: got[k].note for k in ("unsafe", "two", "empty", "broad", "nogroup", "nothing")} == {
        "unsafe": "unsafe_request", "two": "multiple_measures", "empty": "no_intent", "broad": "too_broad_request",
        "nogroup": "missing_grouping", "nothing": "no_intent"}
    assert got["day"].f_day == datetime.date(2026, 5, 4) and got["year"].f_year == 2026
    assert (got["low"].direction, got["low"].top) == ("asc", 1) and got["first"].row_limit == 2
    found = {(r.question_id, r["rank"]): (r.group_value, r.metric_value) for r in batch.execute_aggregates(plans, seed).collect()}
    assert found[("low", 1)] == ("control", 12000.0) and found[("count", 1)] == ("south", 1.0)
    rows = {}
    for r in batch.execute_lists(plans, seed).orderBy("question_id", "rank").collect():
        rows.setdefault(r.question_id, []).append(r.plot_id)
    assert rows["year"] == ["P1", "P2", "P3", "P4"] and rows["day"] == ["P4"] and rows["first"] == ["P1", "P2"]


def test_fuzzy_aliases(spark):
    asked = spark.createDataFrame([(1, "Averge yiel per variet?")], "question_id int, question string")
    found = {(r.section, r.token, r.canonical_name) for r in nq.fuzzy_aliases(asked).collect()}
    assert {("aggregation", "averge", "avg"), ("measure", "yiel", "yield"), ("dimension", "variet", "variety")} <= found


def test_likeness_is_the_ratio_of_matching_blocks(spark):
    """Equality with the standard library's ratio on random words, and the hints that stems and plurals need."""
    g = random.Random(17)
    word = lambda: "".join(g.choice("abcd" if g.random() < .5 else "abcdefghijé") for _ in range(g.randint(0, 14)))
    pairs = [(word(), word()) for _ in range(400)]
    pairs += [(a, "".join(x for x in a + word() if g.random() < .8)) for a, _ in pairs[:200]] + [("", ""), ("a", "a"), ("aaaa", "aa")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: (r.m, r.s) for r in df.select("i", x.matching_letters(F.col("a"), F.col("b")).alias("m"),
                                             x.shared_letters(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        blocks = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        assert got[i][0] == blocks <= got[i][1], (a, b, got[i])


def test_hints_equal_close_matches(spark):
    text = "varieties humid farming counting blocked the meen yieldes how many tretment statuses a of locaton plots 12 moistur"
    asked = spark.createDataFrame([(1, text)], "question_id int, question string")
    got = {(r.section, r.token, r.canonical_name, r.matched_alias) for r in nq.fuzzy_aliases(asked).collect()}
    groups, want = {}, set()
    for _, section, name, _, alias, folded in nq.alias_rows():
        groups.setdefault((section, name), {})[folded] = alias
    for token in text.split():
        for (section, name), aliases in groups.items():
            best = difflib.get_close_matches(token, list(aliases), n=1, cutoff=0.72) if len(token) >= 3 else []
            want |= {(section, token, name, aliases[best[0]])} if best else set()
    assert got == want and ("dimension", "varieties", "variety", "variety") in got
