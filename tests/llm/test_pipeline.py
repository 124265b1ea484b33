import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tallgrid.llm import tiling, toxicity
from tests.llm.conftest import SF, table_rows
from tests.llm.test_pairs import components, shingles
from tests.llm.test_tokens import gapless

LENGTH = 50


def cut(rows):
    """Texts without 50-byte strings that also start in an earlier row."""
    first, out = {}, {}
    for i, t in rows:
        data = t.encode()
        for k in range(len(data) - LENGTH + 1):
            first[data[k:k + LENGTH]] = min(i, first.get(data[k:k + LENGTH], i))
    for i, t in rows:
        data, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(data) - LENGTH + 1):
            if first[data[k:k + LENGTH]] < i:
                gone[k:k + LENGTH] = b"\1" * LENGTH
        at, kept = 0, []
        for ch in t:  # a character cut in part goes as a whole
            size = len(ch.encode())
            kept += [] if any(gone[at:at + size]) else [ch]
            at += size
        out[i] = "".join(kept)
    return out


def test_cuts_fall_between_characters_and_keep_replacement_characters(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    shared = "é" * 40
    rows = [(1, "a" + shared + "\u2014z", "en", "s", 9), (2, "x\ufffdy \u00e8" + shared + "\u2013 \ufffd", "en", "s", 9), (3, "\ufffd only", "en", "s", 9)]
    got = {r["doc_id"]: r["text"] for r in pipeline.cut_repeats(spark, spark.createDataFrame(rows, schema), SF).collect()}
    assert got == cut([(i, t) for i, t, *_ in rows])
    assert got[2] == "x\ufffdy \u00e8 \ufffd" and got[3] == "\ufffd only"


def test_stages_match_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    tables, docs = [], source
    for _, stage in pipeline.STAGES:
        docs = pipeline.keep(stage(spark, docs, SF))
        tables.append(docs)
    calm, single, short, clean, packed = tables
    assert all(t.schema.names == source.schema.names for t in tables[:-1])

    weights = toxicity.train(source, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["_row"]["doc_id"]: r["score"] for r in toxicity.scored(source, weights).collect()}
    own = {r["doc_id"]: r["text"] for r in calm.collect()}
    assert set(own) == {i for i, s in scores.items() if s < toxicity.THRESHOLD}

    found = components(own.items(), percent=80)
    kept = {r["doc_id"]: r["text"] for r in single.collect()}
    assert set(kept) == {i for i, n, c in found if i == c or not n}
    assert all(kept[i] == own[i] for i in kept)

    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in short.collect()}
    assert {i: t for i, (t, _) in left.items()} == cut(kept.items())
    assert all(n == len(t) for t, n in left.values())

    items = [r[1] for r in table_rows(spark, "benchmark")]
    leaked = {r["_id"] for r in tiling.leaks(short, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {i for i, (t, _) in left.items() if any(x in t for x in items)} <= leaked
    last = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(last) == set(left) - leaked

    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, t in last.items():
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = packed.collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert gapless(rows) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_run_gives_the_rows_of_its_stages(spark):
    rows = pipeline.run(spark, SF).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) > 0
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination",
                                                     "packing"]


def test_odd_documents_pass_through(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 70 + "ä" * 60, "de", "s", 9), (4, "ä" * 70, "de", "s", 7),
            (5, None, None, None, None), (None, "a few words under no id", None, None, None), (3, "word " * 70 + "ä" * 60, "de", "s", 9)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in pipeline.STAGES[1:-1]:
        docs = pipeline.keep(stage(spark, docs, SF))
        assert docs.schema.names == schema.names
    got = sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect() if r["text"])
    assert got == [(0, "a few words under no id"), (3, "word " * 70 + "ä" * 60)]
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 2, 3, 4, 5]
    assert not shingles(None)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), SF).count() == 0
