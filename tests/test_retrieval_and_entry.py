import os
import pathlib
import random
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tallgrid.operators import queries, retrieval as r
from tallgrid.registry import tables
from tests.test_values import fold_python

SMALL = "/root/testdata/sf0.001"
KEEP = set("abcdefghijklmnopqrstuvwxyz0123456789%/._-")


def test_score_equals_brute_force(spark):
    generator = random.Random(5)
    word = lambda: "".join(generator.choice("abé") for _ in range(generator.randint(1, 5)))
    docs = [(f"d{i}", 0, i, "t", " ".join(word() for _ in range(2)), " ".join(word() for _ in range(12)),
             {"k": word(), "plot": word()}, None) for i in range(60)]
    asked = [(f"q{i}", " ".join(word() for _ in range(generator.randint(1, 3)))) for i in range(25)] + [("none", "! a")]
    got = {(x.query_id, x.document_id): x.score for x in r.score(
        spark.createDataFrame(asked, "query_id string, query string"), spark.createDataFrame(docs, r.DOC_SCHEMA)).collect()}
    want = {}
    for query_id, text in asked:
        folded = fold_python(text, KEEP)
        tokens = {t for t in folded.split(" ") if len(t) >= 2}
        for doc in docs:
            title, body = fold_python(doc[4], KEEP), fold_python(doc[5], KEEP)
            meta = fold_python(" ".join(p for kv in doc[6].items() for p in kv), KEEP)
            points = sum(5 * (t in title) + 2 * (t in body) + (t in meta) for t in tokens)
            points += 25 if tokens and folded in " ".join(p for p in (title, body, meta) if p) else 0
            if points:
                want[(query_id, doc[0])] = float(points)
    assert got == want


def test_benchmark_queries_are_whole_texts(spark):
    docs, want, hits = [], {}, {}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        parts = [fold_python(p, KEEP) for p in (f"{d.lang} {d.source}", d.text or "", f"lang {d.lang} source {d.source}")]
        docs.append((f"doc:{d.doc_id}", d.source, f"{d.lang} {d.source}".lower(), parts, " ".join(p for p in parts if p)))
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    assert all(len(i.text.split()) > 5 for i in items)
    for i in items:
        folded = fold_python(i.text, KEEP)
        tokens = {t for t in folded.split(" ") if len(t) >= 2}
        for name, source, title, parts, whole in docs:
            points = sum(n * (t in part) for n, part in zip((5, 2, 1), parts) for t in tokens) + 25 * (folded in whole)
            if points:
                want[i.item_id, name] = float(points)
                hits.setdefault(i.item_id, []).append((-points, source, title, name))
    ranked = {(i, rank): h[3] for i, rows in hits.items() for rank, h in enumerate(sorted(rows)[:10], start=1)}
    run = lambda name: entry.queries()[name](spark, SMALL).collect()
    assert {(x.query_id, x.document_id): x.score for x in run("r03_score")} == want
    assert {(x.query_id, x.rank): x.document_id for x in run("r04_top_k")} == ranked
    assert {(x.query_id, x.rank): x.document_id for x in run("r05_search_with_snippets")} == {
        k: v for k, v in ranked.items() if k[1] <= 5}


def test_pruned_ranking_equals_full_scores(spark):
    """The same rows as ranking all scores, from a fraction of the pairs, on whole benchmark texts and on odd queries."""
    from tallgrid.registry import retrieving
    docs = retrieving.corpus(spark, SMALL)
    odd = spark.createDataFrame([(10_001, "src1"), (10_002, "! a"), (10_003, "en src3 the of and"), (10_004, "zzzzzz qqqqq"),
                                 (10_005, "the"), (10_006, "lang en source src2"), (10_007, None)], "query_id long, query string")
    asked = retrieving.asked(spark, SMALL).unionByName(odd)
    rows = lambda df: sorted((x.query_id, x["rank"], x.document_id, x.score) for x in df.collect())
    for k in (1, 7):
        assert rows(r.ranked(asked, docs, k)) == rows(r.top_k(r.score(asked, docs), docs, k))
    long = retrieving.asked(spark, SMALL)
    read, every = r.candidates(long, docs, 1).count(), r.score(long, docs).count()
    assert read < 0.35 * every, (read, every)


def test_context_prefers_schema_documents(spark, seed):
    docs = r.schema_docs(spark, seed)
    chosen = r.select_context(docs, variable="yield", question="moisture percent", limit=8).orderBy("stage", "ord").collect()
    ids = [x.document_id for x in chosen]
    assert ids[:3] == ["schema:overview", "query:metadata", "validation:overview"]
    assert ids[3:5] == ["canonical:measure:yield", "units:yield"] and "units:moisture" in ids and len(set(ids)) == len(ids) <= 8


def test_names_agree_and_the_flagship_runs(spark):
    names, checked = set(entry.queries()), set(entry.oracle_sql())
    assert checked <= names and len(names) > 120
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [["tallgrid/llm", "tests/llm"], ["tallgrid/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_works_without_text_preparation(tmp_path, gone):
    """A copy of the repository without the optional folders still registers everything else."""
    root = pathlib.Path(entry.__file__).parent
    skipped = {str(root / g) for g in gone}
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__") or f"{folder}/{n}" in skipped])
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n[:2] == 'op' for n in q), 'pipeline' in q, len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")})
    assert got.returncode == 0, got.stderr
    total, operators, pipeline, oracles = got.stdout.split()
    assert int(total) > 150 and operators == "0" and pipeline == "False" and int(oracles) > 140


@pytest.mark.parametrize("name", ["q06_avg_by_variety", "q13_avg_plan_by_plot", "r04_top_k", "h01_h06_unpivoted_observations",
                                  "t18_t19_enriched_columns", "n10_plan_a"])
def test_plans_stay_on_the_jvm_without_cross_joins(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_scans_are_pruned_and_duplicates_are_skipped_when_unused(spark):
    def plan(name):
        return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    # reads scan the committed table alone, and only the columns that they name
    for name in ("q06_avg_by_variety", "q09_distinct_values", "q20_quality_summary"):
        shown = plan(name)
        assert len(re.findall(r"FileScan parquet", shown)) == 1 and "Join" not in shown
    average = plan("q06_avg_by_variety")
    assert not re.search(r"FileScan parquet [^\n]*source_sheet#", average)
    # no sort below the large aggregation
    assert average.count("SortAggregate") <= 2 and "HashAggregate" in average
    # before the commit, an average needs the blocking flags only: the duplicate count and its shuffle disappear
    fresh = queries.aggregate(tables.validated(spark, SMALL), "variety", "avg_normalized_value", {"variable": "yield"})
    assert "_dup" not in fresh._jdf.queryExecution().executedPlan().toString()


def test_hot_duplicate_key_is_counted_in_parts(spark):
    """One key holding most rows reaches the shuffle as one partial count per task."""
    from pyspark.sql import functions as F
    from tallgrid import catalog
    from tallgrid.operators import quality
    raw = tables.raw_observations(spark, SMALL)
    hot = raw.withColumns({k: F.lit("same").cast(dict(raw.dtypes)[k]) if k != "observation_date" else F.lit(None).cast("date")
                           for k in catalog.DUPLICATE_KEY})
    flagged = quality.flag_duplicates(hot)
    assert flagged.filter("is_duplicate").count() == raw.count()
