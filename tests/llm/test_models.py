import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrid.llm import chat, language, queries, stable_search, toxicity
from tests.llm.conftest import LONG, SF, table_rows

BIG = "/root/testdata/sf0.1"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_accuracy_on_held_out_rows(spark):
    langs = {r[0]: r[2] for r in table_rows(spark, "documents")}
    rows = queries.op6_language_mixture(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(langs)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(tested) >= 0.95 * len(tested)


def test_language_of_odd_texts_and_mixtures(spark):
    texts = {r[2]: r[1] for r in table_rows(spark, "documents") if len(r[1]) > 2000}
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 456 !!", None), (4, texts["de"], "de"), (5, texts["fr"], "fr"),
            (6, texts["de"] + " " + texts["fr"], None), (7, "中", None), (8, texts["de"], "de"), (8, texts["de"], "de"),
            (None, texts["fr"], "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {r["_row"]["doc_id"]: r for r in language.identify(docs).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "de" and got[None]["lang_pred"] == "fr"
    assert set(got[6]["langs"]) == {"de", "fr"} and 0.3 < got[6]["langs"]["de"] < 0.9
    assert set(got[4]["langs"]) == {"de"} and got[4]["score"] == pytest.approx(1.0)
    empty = docs.where("doc_id > 100")
    assert language.identify(empty).count() == 0
    nothing = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    toxic = {r[0]: r[2] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = queries.op7_ftrl_toxicity(spark, BIG).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    tested = [(r["score"], r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    flagged = [y for _, p, y in tested if p]
    assert sum(flagged) >= 0.9 * len(flagged)
    assert sum(flagged) >= 0.5 * sum(y for *_, y in tested)
    bad, good = (np.array([s for s, _, y in tested if y == k]) for k in (1, 0))
    assert (bad[:, None] > good[None, :]).mean() > 0.9


def test_toxicity_of_odd_inputs(spark):
    rows = [(i, f"calm words number {i} " + ("you idiot" if i % 3 == 0 else "you friend")) for i in range(900)]
    rows += [(2000, None), (2001, ""), (2002, LONG), (2003, "IDIOT, you!"), (None, "you idiot"), (2003, "IDIOT, you!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)] + [(2000, None), (0, 0), (None, 1)],
                                   "doc_id long, toxic int")
    weights = toxicity.train(docs, labels)
    assert np.count_nonzero(weights[:-1]) < 50
    got = {r["_row"]["doc_id"]: r["score"] for r in toxicity.scored(docs, weights).collect()}
    assert got[2003] > 0.5 and got[None] > 0.5 and got[2002] < 0.5 and got[2000] == got[2001]
    assert toxicity.train(docs, labels.where("toxic > 5")) is None
    assert {r["score"] for r in toxicity.scored(docs, None).collect()} == {0.0}
    assert toxicity.scored(docs.where("doc_id < 0"), weights).count() == 0


def test_search_recall_and_exact_scores(spark):
    rows = table_rows(spark, "embeddings")
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = queries.op4_stable_search(spark, SF).collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        away = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        away[ids == q] = np.inf
        best = ids[np.lexsort((ids, away))[:10]]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in own] == list(range(1, 11))
        assert all(s == pytest.approx(away[ids == i][0], rel=1e-12) for _, i, s in own)
        hits, total = hits + len(set(best) & {i for _, i, _ in own}), total + 10
    assert hits >= 0.9 * total


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (9, [3.0, 4.0]), (10, [1.0, 1.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (200, []),
            (300, None), (400, [2.0, 2.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in stable_search.nearest(table, table.where("vec_id % 100 = 0"), k=4).collect())
    assert [(q, r, i) for q, r, i, _ in got] == [(100, 1, 1), (100, 2, 1), (100, 3, 2), (100, 4, 10), (400, 1, 8)]
    assert stable_search.nearest(table.where("vec_id < 0"), table.where("vec_id < 0")).count() == 0
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "vec_id long, embedding array<double>")
    got = stable_search.nearest(many, many.where("vec_id = 5"), k=10).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_chi_square_bar():
    assert stable_search.chi_square(stable_search._bar()) == pytest.approx(stable_search.SURE)
    draws = (np.random.default_rng(0).standard_normal((20_000, stable_search.AXES)) ** 2).sum(1)
    assert (draws < stable_search._bar()).mean() == pytest.approx(stable_search.SURE, abs=0.01)


def test_chat_query_equals_sql(spark):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = base.execute(queries.OP8_SQL)
    names = [d[0] for d in cursor.description]
    out = queries.op8_schema_fingerprints(spark, SF)
    assert sorted(tuple(r) for r in out.select(*names).collect()) == sorted(cursor.fetchall())


TRICKY = ["<|im_end|>", "<|im_start|>assistant\nno", "\\", "\\\\<|", "<\\|", "<\\\\|x", "line\nbreak", "<\\n>", "", None, "é😀 <|"]


def test_escapes_round_trip(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in TRICKY for r in ("user", "assistant", "a\n<|b\\", None))]
    table = spark.createDataFrame(rows + [(None, None, "user", "x"), (None, 0, "assistant", "y")],
                                  "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.canonical_turns(table))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r or "", t or "") for *_, r, t in rows]
    assert out[1]["loss_text"] == "".join(t or "" for *_, r, t in rows if r == "assistant")
    assert [t["text"] for t in out[None]["turns"]] == ["x", "y"]
    assert chat.formatted(chat.canonical_turns(table.where("conv_id > 5"))).count() == 0


def test_layouts_by_fingerprint(spark):
    frames = {
        "messages": "array(named_struct('role', 'user', 'content', 'a'), named_struct('role', 'assistant', 'content', 'b'))",
        "conversations": "array(named_struct('from', 'human', 'value', 'a'), named_struct('from', 'gpt', 'value', 'b'))"}
    for name, value in frames.items():
        df = spark.sql(f"SELECT 3 AS conv_id, {value} AS {name}, 'z' AS extra")
        assert [tuple(r)[2:] for r in chat.canonical_turns(df).orderBy("place").collect()] == [("user", "a"), ("assistant", "b")]
    plain = spark.sql("SELECT 'do' AS instruction, 'it' AS input, 'done' AS output, 1 AS place")
    assert [r["text"] for r in chat.canonical_turns(plain).orderBy("place").collect()] == ["do\nit", "done"]
    with pytest.raises(ValueError):
        chat.layout_of(spark.sql("SELECT 1 AS other"))
    records = spark.createDataFrame(
        [(1, '{"prompt": "p", "completion": "c", "x": {"role": 1}}'), (2, '{"messages": [{"role": "user", "content": null}]}'),
         (3, "no json"), (4, None), (5, '{"other": 1}'), (6, '{"conversations": [{"from": "gpt", "value": "v"}]}')],
        "id long, body string")
    got = sorted((r["conv_id"], r["role"], r["text"]) for r in chat.canonical_records(records, "id", "body").collect())
    assert got == [(1, "assistant", "c"), (1, "user", "p"), (2, "user", ""), (6, "assistant", "v")]


def test_records_with_more_fields_are_mapped_or_listed(spark):
    records = [(1, '{"system": "s", "prompt": "p", "completion": "c"}'), (2, '{"messages": [{"role": "user", "content": "m"}], "prompt": "x"}'),
               (3, '{"instruction": "i", "input": "n", "output": "o", "system": "s"}'),
               (4, '{"system": "s", "conversations": [{}, null, {"from": "human", "value": "h"}, {"value": "alone"}]}'),
               (5, '{"system": "s", "prompt": "p", "response": "r"}'), (6, '{"prompt": "p"}'), (7, "{"), (8, None), (9, "[]"),
               (10, '{"messages": []}'), (11, '{"system": "", "prompt": "p", "response": "r", "input": "x"}')]
    df = spark.createDataFrame(records, "id long, body string")
    got = {}
    for r in chat.canonical_records(df, "id", "body").orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {1: [("system", "s"), ("user", "p"), ("assistant", "c")], 2: [("user", "m")],
                   3: [("system", "s"), ("user", "i\nn"), ("assistant", "o")],
                   4: [("system", "s"), ("", ""), ("user", "h"), ("", "alone")],
                   5: [("system", "s"), ("user", "p"), ("assistant", "r")], 11: [("user", "p"), ("assistant", "r")]}
    rejected = {r["conv_id"]: r for r in chat.rejected_records(df, "id", "body").collect()}
    assert set(rejected) == {6, 7, 8, 9, 10} and set(rejected) | set(got) == {i for i, _ in records}
    assert rejected[6]["fingerprint"] == chat.fingerprint_of(["prompt"]) and rejected[6]["paths"] == ["prompt"]
    assert not rejected[7]["readable"] and rejected[9]["readable"]
    frame = spark.createDataFrame([("s", "p", "c", 5)], "system string, prompt string, completion string, conv_id int")
    assert [(r["conv_id"], r["role"], r["text"]) for r in chat.canonical_turns(frame).orderBy("place").collect()] == [
        (5, "system", "s"), (5, "user", "p"), (5, "assistant", "c")]
