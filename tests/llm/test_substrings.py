import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrid.llm import queries, rolling, suffix_levels, window_dedup
from tests.llm.conftest import SF, removed, table_rows

OPERATORS = [(window_dedup.remove_repeats, True), (suffix_levels.remove_repeats, False)]


def result(out):
    own = F.coalesce(F.col("_row.doc_id"), F.lit(2**63 - 1))
    return sorted(tuple(r) for r in out.select(own, "n_symbols", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


@pytest.mark.parametrize("operator, by_word", OPERATORS)
def test_odd_documents_match_brute_force(make_docs, odd_rows, operator, by_word):
    docs = make_docs(odd_rows)
    out = operator(docs)
    assert out.schema["_row"].dataType == docs.schema
    assert result(out) == removed(odd_rows, 50, by_word)


@pytest.mark.parametrize("operator, by_word", OPERATORS)
def test_shifted_overlaps_match_brute_force(make_docs, operator, by_word):
    rng = np.random.default_rng(3)
    base = [f"t{x}" for x in rng.integers(0, 40, 400)]
    rows = []
    for i in range(40):
        a, b = sorted(rng.integers(0, 400, 2))
        c, d = sorted(rng.integers(0, 400, 2))
        rows.append((int(i * 7 % 40), " ".join(base[a:b] + [f"own{i}"] + base[c:d])))
    assert result(operator(make_docs(rows), length=12)) == removed(rows, 12, by_word)


@pytest.mark.parametrize("operator, by_word", OPERATORS)
def test_empty_table(make_docs, operator, by_word):
    assert operator(make_docs([]).where("doc_id > 0")).count() == 0


@pytest.mark.parametrize("name, by_word", [("op3_window_dedup", True), ("op9_suffix_levels", False)])
def test_queries_match_brute_force(spark, name, by_word):
    got = sorted((r["doc_id"], r["n_words" if by_word else "n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                 for r in queries.QUERIES[name][0](spark, SF).collect())
    assert got == removed([(r[0], r[1]) for r in table_rows(spark, "documents")], 50, by_word)


def test_rolling_hashes_tell_windows_apart_by_content_only():
    values = np.array([5, 6, 7, 8, 5, 6, 7, 9, 5, 6, 7], np.uint64)
    prefix = rolling.Prefix(values)
    windows = prefix.windows(3)
    assert windows[0] == windows[4] == windows[8] and len(set(windows.tolist())) == 7
    assert prefix.ranges(np.array([0, 4]), np.array([3, 7])).tolist() == windows[[0, 4]].tolist()


def test_runs_cover_every_window_once_and_follow_content():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 500).astype(np.uint8)
    data, bounds = np.concatenate([text, text[100:400], text[:30]]), np.array([0, 500, 800, 830])
    document, start, count, seed, run = rolling.runs(rolling.Prefix(data), bounds, 50)
    seen = [s + k for s, n in zip(start, count) for k in range(n)]
    assert seen == [*range(451), *range(500, 751)] and set(document) == {0, 1}
    inner = {(r, n) for d, s, n, r in zip(document, start, count, run) if d == 0 and 120 <= s < 300}
    assert inner <= {(r, n) for d, n, r in zip(document, count, run) if d == 1}


def test_levels_keep_geometric_sizes_and_least_ids():
    family, rng = suffix_levels.Levels(), np.random.default_rng(0)
    seen = {}
    for k in range(16):
        batch = np.zeros(200, suffix_levels.ENTRY)
        batch["order"], batch["id"] = rng.integers(0, 1500, 200), rng.integers(0, 900, 200)
        for q, i in zip(batch["order"].tolist(), batch["id"].tolist()):
            seen[q] = min(i, seen.get(q, i))
        family.add(batch)
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    array = family.close()
    assert dict(zip(array["order"].tolist(), array["id"].tolist())) == seen
    marked = np.concatenate(family.marked)
    assert all(i > seen[q] for q, i in zip(marked["order"].tolist(), marked["id"].tolist()))
    assert len(marked) + len(array) == 16 * 200


def test_slices_take_long_rows_alone():
    column = pa.array(["ab", None, "c" * 50, "", "d"])
    got = [(row, data.tobytes(), bounds.tolist()) for row, data, bounds in rolling.slices(column, 10)]
    assert b"".join(g[1] for g in got) == b"ab" + b"c" * 50 + b"d"
    assert [row + k for row, _, bounds in got for k in range(len(bounds) - 1)] == list(range(5))
