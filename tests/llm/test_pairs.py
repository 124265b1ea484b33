import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallgrid.llm import chosen_path, graph, queries, tiling
from tests.llm.conftest import SF, table_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    whole = frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else whole


def components(rows, percent=85):
    """Brute force: (id, set size, least id of the component)."""
    rows = [(LAST if i is None else i, shingles(t)) for i, t in rows]
    parent, holders = list(range(len(rows))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (_, own) in enumerate(rows):
        common = Counter(m for s in own for m in holders[s])
        for s in own:
            holders[s].append(n)
        for m, k in common.items():
            if 100 * k >= percent * (len(own) + len(rows[m][1]) - k):
                parent[find(n)] = find(m)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(i, least.get(find(n), i))
    return sorted((i, len(own), least[find(n)]) for n, (i, own) in enumerate(rows))


def found(docs, **options):
    out = chosen_path.near_duplicates(docs, **options)
    return sorted(tuple(r) for r in out.select("_id", "n_shingles", "component_id").collect())


def edited(base, *places):
    words = base.split(" ")
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


BASE = " ".join(f"b{i}" for i in range(200))


def test_odd_documents(make_docs, odd_rows):
    assert found(make_docs(odd_rows)) == components(odd_rows)


def test_chain_of_edits_and_case(make_docs):
    rows = [(i, edited(BASE, *range(0, 8 * i, 8))) for i in range(9)] + [(50, BASE.upper()), (51, "B0 " + BASE)]
    assert found(make_docs(rows)) == components(rows)


@pytest.mark.parametrize("node", [2, 5])
def test_large_nodes_go_through_pivots(make_docs, monkeypatch, node):
    monkeypatch.setattr(chosen_path, "NODE", node)
    monkeypatch.setattr(chosen_path, "PIVOTS", 2)
    rows = [(i, edited(BASE, (7 * i) % 190)) for i in range(30)] + [(i, f"line {i} " * 30) for i in range(100, 106)]
    assert found(make_docs(rows)) == components(rows)


def templates(groups, own, shared, template=150):
    """Pairs on one template: each pair has ``shared`` words of its own, each text ``own`` more."""
    base, rows = [f"t{i}" for i in range(template)], []
    for g in range(groups):
        mine = [f"g{g}s{i}" for i in range(shared)]
        rows += [(10 * g + k, " ".join(base + mine + [f"g{g}k{k}o{i}" for i in range(own)])) for k in range(2)]
    return rows


def test_links_of_large_nodes_across_components(make_docs, monkeypatch):
    for name, value in (("NODE", 8), ("PIVOTS", 2), ("DEPTH", 1)):
        monkeypatch.setattr(chosen_path, name, value)
    # chains beside near copies: few of them are linked with a pivot
    rows = templates(60, 16, 60) + [(5000 + i, edited(BASE, *range(0, 8 * (i % 12), 8), 190 - i % 7)) for i in range(36)]
    assert found(make_docs(rows)) == components(rows)


def test_template_at_the_threshold_is_found_at_any_depth(make_docs, monkeypatch):
    """Shingles of the template are two thirds of a pair's union, all hot; pairs are just over 0.8."""
    monkeypatch.setattr(chosen_path, "NODE", 6)
    rows = templates(150, 20, 20)
    want = components(rows, 80)
    assert len({c for _, _, c in want}) == 150
    assert found(make_docs(rows), percent=80) == want


def test_trees_and_sketches_reach_the_stated_recall():
    for percent in (50, 80, 85, 95):
        assert (1 - percent / 100) ** chosen_path.trees_for(percent) <= chosen_path.MISS
    assert chosen_path.trees_for(85) == chosen_path.trees_for(80) == chosen_path.TREES < chosen_path.trees_for(50)
    assert chosen_path.least_matches(80) < chosen_path.least_matches(85)


def test_empty_table(make_docs):
    docs = make_docs([]).where("doc_id > 0")
    assert found(docs) == []
    assert chosen_path.representatives(docs).count() == 0


def test_representatives_keep_one_row_of_each_group(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = chosen_path.representatives(docs, percent=85)
    assert kept.schema == docs.schema
    want = Counter(c for _, n, c in components(odd_rows) if n)
    rows = kept.collect()
    filled = [r for r in rows if shingles(r["text"])]
    assert len(filled) == len({(c, shingles(r["text"])) for r in filled for c in [r["doc_id"]]})
    assert sum(not shingles(r["text"]) for r in rows) == sum(n == 0 for _, n, _ in components(odd_rows))
    assert {r["doc_id"] for r in filled} <= set(want)
    assert [r["text"] for r in rows if r["doc_id"] == 5] == [odd_rows[4][1]]


def test_query_matches_brute_force(spark):
    rows = [(r[0], r[1]) for r in table_rows(spark, "documents")]
    got = queries.op10_chosen_path(spark, SF).collect()
    assert sorted(tuple(r)[:3] for r in got) == components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 301), (301, 300), (400, 400)]
    links = spark.createDataFrame(edges, "a long, b long")
    roots = {r.v: r.root for r in graph.components(links).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}, 301: 300}


ITEM = "The quick brown fox jumps over the lazy dog. Pack my box with five dozen jugs of wine tonight please"


def test_tiles_catch_moved_passages_once(make_docs, spark):
    first, second = ITEM.split(". ")
    rows = [(1, f"intro words {second} and between {first} outro"), (2, ITEM.lower().replace(" ", " *** ") + " tail"),
            (3, f"only {first} here"), (4, first + " " + first + " " + first), (5, None), (6, ""), (7, "clean text"), (2, ITEM),
            (None, ITEM)]
    bench = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (13, ""), (None, ITEM), (14, ITEM)],
                                  "item_id long, text string")
    out = tiling.leaks(make_docs(rows), bench)
    got = sorted((r["_id"], r["item_id"], r["n_tiles"], r["n_covered"]) for r in out.collect())
    assert got == sorted((i, item, tiles, 20) for item in (10, 14)
                         for i, tiles in ((1, 2), (2, 1), (2, 1), (LAST, 1)))
    clean = tiling.without_leaks(make_docs(rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6, 7]
    assert clean.schema == make_docs(rows).schema


def test_tiling_over_blocks_and_empty_tables(make_docs, spark, monkeypatch):
    bench = spark.createDataFrame([(k, ITEM + f" number{k}") for k in range(6)], "item_id long, text string")
    docs = make_docs([(1, ITEM), (2, "nothing of it")])
    whole = sorted(tuple(r) for r in tiling.leaks(docs, bench).collect())
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 30)
    assert sorted(tuple(r) for r in tiling.leaks(docs, bench).collect()) == whole and len(whole) == 6
    assert [r["doc_id"] for r in tiling.without_leaks(docs, bench).collect()] == [2]
    assert tiling.leaks(docs, bench.where("item_id < 0")).count() == 0
    assert tiling.leaks(docs.where("doc_id < 0"), bench).count() == 0


def plain_tiles(item, doc, tile):
    """Greedy string tiling as published: longest first, nothing marked twice."""
    used_item, used_doc, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while (a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n]
                       and not used_item[a + n] and not used_doc[b + n]):
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < tile:
            return covered
        covered += n
        for k in range(n):
            used_item[a + k] = used_doc[b + k] = True


def test_query_covers_as_plain_tiling_does(spark):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOWER))
    docs = {r[0]: words(r[1]) for r in table_rows(spark, "documents")}
    items = {r[0]: words(r[1]) for r in table_rows(spark, "benchmark")}
    got = {(r["doc_id"], r["item_id"]): r for r in queries.op2_string_tiling(spark, SF).collect()}
    for i, item in items.items():
        grams = {tuple(item[k:k + 5]) for k in range(len(item) - 4)}
        for d, doc in docs.items():
            shared = sum(tuple(doc[k:k + 5]) in grams for k in range(len(doc) - 4))
            covered = plain_tiles(item, doc, 5) if shared * 5 >= 0.6 * len(item) else 0
            assert ((d, i) in got) == (covered >= 0.6 * len(item) and covered > 0)
            if (d, i) in got:
                assert got[d, i]["n_covered"] == covered and got[d, i]["n_words"] == len(item)
