import hashlib
import re

import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(30_000))
DOCS = "doc_id long, text string, _id string, _row int, kept string, partial boolean"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators use inside."""
    def build(rows):
        return spark.createDataFrame([(i, t, f"x{i}", 7, "kept", True) for i, t in rows], DOCS)
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, short and very long ones, equal and repeated rows, one id with two texts."""
    passage = " ".join(f"passage{i}" for i in range(60))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, passage), (6, "before it " + passage + " after it"), (5, passage),
            (7, LONG), (8, LONG + " tail"), (9, passage.upper()), (10, "é" * 40 + passage + "é" * 40), (11, "a b c d e"),
            (12, "a b c d e"), (11, "another text under the id eleven"), (None, passage), (13, "no\x1cbreak here " + passage)]


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def removed(rows, length, by_word):
    """Brute force of both substring operators: (id, symbols, removed, runs, sha256 of what is left)."""
    own = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    own = [(i, WORD.findall(b) if by_word else b) for i, b in own]
    first, out = {}, []
    cut = (lambda s, k: tuple(s[k:k + length])) if by_word else (lambda s, k: s[k:k + length])
    for i, s in own:
        for k in range(len(s) - length + 1):
            first[cut(s, k)] = min(i, first.get(cut(s, k), i))
    for i, s in own:
        gone = bytearray(len(s))
        for k in range(len(s) - length + 1):
            if first[cut(s, k)] < i:
                gone[k:k + length] = b"\1" * length
        kept = (b" ".join if by_word else bytes)(x for x, g in zip(s, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(s), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def table_rows(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
