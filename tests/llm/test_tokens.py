import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallgrid.llm import packing, queries, repair, tokens
from tests.llm.conftest import SF, table_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BITS = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "it's", "don't", "12", "3.5", "é", " ", " ", "…", "中文", "。", "'", "''", "$$",
        ".", ",", "<|endoftext|>", "😀", "\x1c", "_x", "\r\n", "x'y", "-", "<|"]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def encode(texts):
    out = []
    for _, ids, bounds in tokens.encoded(pa.array(texts, pa.string()), PATH, 0):
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join), min_size=1, max_size=12))
def test_ids_equal_the_library(texts):
    assert encode(texts) == [expected(t) for t in texts]


def test_known_pieces_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_LIMIT", 20)
    texts = [" ".join(f"word{i}x{k}" for i in range(30)) for k in range(5)]
    assert encode(texts) == [expected(t) for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def pieces_of(i, text):
    ids = expected(text)
    cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
    return [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def gapless(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_op1_reads_back_what_the_library_encodes(spark):
    start, want = 0, []
    for i, text, *_ in sorted(table_rows(spark, "documents")):
        ids = expected(text)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op1_repair_shards(spark, SF).collect()) == want


def test_op5_packs_every_piece(spark):
    rows = queries.op5_best_fit_packing(spark, SF).collect()
    docs = table_rows(spark, "documents")
    assert sorted(tuple(r)[:5] for r in rows) == sorted(p for i, text, *_ in docs for p in pieces_of(i, text))
    total = sum(r["length"] for r in rows)
    assert gapless(rows) <= -(-total // 2048) + 1


def test_odd_documents(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = packing.pack_documents(docs, PATH).collect()
    last = lambda i: 2**63 - 1 if i is None else i
    want = sorted(p for i, text in odd_rows for p in pieces_of(last(i), text))
    assert sorted((r["_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    gapless(rows)
    files = repair.write_shards(docs, PATH)
    read = repair.read_shards(files).orderBy("start").collect()
    assert [r["_id"] for r in read] == sorted(last(i) for i, _ in odd_rows)
    assert [r["start"] for r in read] == np.cumsum([0] + [r["n_tokens"] for r in read])[:-1].tolist()
    assert sorted((r["_id"], r["ids_crc32"]) for r in read) == sorted((last(i), crc(expected(t))) for i, t in odd_rows)


def test_empty_table(make_docs):
    docs = make_docs([]).where("doc_id > 0")
    assert packing.pack_documents(docs, PATH).count() == 0
    assert repair.read_shards(repair.write_shards(docs, PATH)).count() == 0


@pytest.mark.parametrize("n, kinds", [(0, 3), (1, 3), (5000, 3), (20_000, 300), (3000, 2)])
def test_grammar_round_trip_and_random_access(n, kinds):
    ids = (np.random.default_rng(n).zipf(1.3, n) % kinds).astype(np.uint16)
    rules, symbols = repair.compress(ids, 300)
    lengths = repair.rule_lengths(rules, 300)
    assert (repair.decode(rules, lengths, symbols, 300) == ids).all()
    assert n < 5000 or len(symbols) < n
    sizes = np.append(np.ones(300, np.int64), lengths)[symbols]
    marks = np.append(0, np.cumsum(sizes))[:-1:repair.STRIDE]
    for a, b in ((0, min(n, 1)), (n // 3, n // 2), (n - n // 5, n)) if n else ():
        assert (repair.decode_range(rules, lengths, symbols, marks, 300, a, b) == ids[a:b]).all()


@pytest.mark.parametrize("capacity, n", [(2048, 2000), (10, 60), (7, 300), (1, 5)])
def test_placements_are_whole_and_gapless(capacity, n):
    random.seed(n)
    sizes = [min(capacity, 1 + int(random.expovariate(3 / capacity))) for _ in range(n)]
    rows, seen = [], Counter()
    for size, low, high, sequence, each, offset in packing.placements(dict(Counter(sizes)), capacity):
        seen[size] += high - low
        rows += [{"sequence_id": sequence + k // each, "offset": offset + k % each * size, "length": size}
                 for k in range(high - low)]
    assert seen == Counter(sizes)
    assert gapless(rows, capacity) <= -(-sum(sizes) * 12 // (capacity * 10)) + 1


def test_large_items_pair_at_most_twice():
    rows = packing.placements({6: 3, 5: 2, 4: 4}, 10)
    per = Counter()
    for _, low, high, sequence, each, _ in rows:
        for k in range(high - low):
            per[sequence + k // each] += 1
    assert max(per.values()) == 2 and len(per) == 5
