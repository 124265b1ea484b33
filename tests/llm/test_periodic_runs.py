"""Periodic runs against brute force over all periods."""

import random
import re

import numpy as np
import pytest

from tallgrid.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """(words, runs, kept): maximal stretches by comparing the text with itself at every distance."""
    words = WORD.findall(text or "")
    names, n = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, int), len(words)
    least = {}
    for q in range(1, n // pr.TIMES + 1):
        edge = np.diff(np.concatenate([[0], (names[:-q] == names[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if e + q - s >= max(pr.LEAST, pr.TIMES * q):
                least.setdefault((s, e + q - s), q)
    runs = sorted((s, length, q) for (s, length), q in least.items())
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return n, runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def collapsed(make_docs, rows):
    out = pr.collapse(make_docs(rows)).collect()
    return sorted((r["_row"]["doc_id"] or 0, r["_row"]["text"] or "", r["n_words"], [tuple(x) for x in r["runs"]],
                   r["kept"].decode()) for r in out)


def expected(rows):
    return sorted((i or 0, t or "", *brute(t)) for i, t in rows)


def periodic(g, n, parts):
    """Words with periodic stretches of the given (period, length), other words between them, alphabets small and large."""
    out = []
    for q, length in parts:
        out += [f"u{g.randrange(10**9)}" for _ in range(g.randrange(n))]
        base = [g.choice("abc") + str(g.randrange(40 if q > 5 else 2)) for _ in range(q)]
        out += [base[i % q] for i in range(length)]
    return " ".join(out)


def test_small_alphabets_and_odd_rows(make_docs, odd_rows):
    g = random.Random(11)
    rows = [(100 + i, " ".join(g.choice("ab" if i % 2 else "abc") for _ in range(g.randrange(60)))) for i in range(300)]
    rows += [(500 + i, " ".join((list("aab") * 30)[:n]) + " x " + " ".join(["z"] * n)) for i, n in enumerate(range(3, 40))]
    rows += odd_rows + rows[:3]
    assert collapsed(make_docs, rows) == expected(rows)


def test_long_periods_over_many_tiles(make_docs):
    g = random.Random(12)
    rows = [(1, periodic(g, 500, [(255, 1020), (256, 1024), (257, 1400), (300, 20_000)])),
            (2, periodic(g, 9000, [(511, 2044), (1, 9000), (2, 5000), (1300, 5199), (1300, 5200)])),
            (3, periodic(g, 3, [(q, 4 * q) for q in range(1, 120)])),
            (4, " ".join(["same"] * 30_000)), (5, periodic(g, 2, [(4000, 17_000), (64, 8000), (7, 9000)])),
            (6, " ".join(f"w{bin(i).count('1') % 2}" for i in range(20_000)))]
    want = expected(rows)
    assert [r[3] for r in want][3] == [(0, 30_000, 1)] and any(q == 4000 for _, _, q in want[4][3])
    assert collapsed(make_docs, rows) == want


def test_texts_over_the_length_for_one_task(make_docs):
    g = random.Random(13)
    text = periodic(g, 10_000, [(9, 40_000), (700, 300_000), (3, 200_000)]) + " " + " ".join(
        f"tail{i}" for i in range(220_000))
    assert len(text) > pr.LONG
    (_, _, n, runs, kept), = collapsed(make_docs, [(1, text)])
    words = text.split(" ")
    assert n == len(words) and [(q, length >= {9: 40_000, 700: 300_000, 3: 200_000}[q]) for _, length, q in runs] == [
        (9, True), (700, True), (3, True)]
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    assert kept == " ".join(w for i, w in enumerate(words) if i not in gone)
    for s, length, q in runs:
        assert words[s:s + length - q] == words[s + q:s + length]
        assert words[s - 1] != words[s - 1 + q] and words[s + length] != words[s + length - q]


def test_empty_table(make_docs):
    assert collapsed(make_docs, []) == []


@pytest.mark.parametrize("size", [0, 1, 4096, 4097, 100_000])
@pytest.mark.parametrize("scale", [0, 1, 4])
def test_tiles_cover_and_overlap(size, scale):
    high, starts = pr.limits(scale)[1], pr.tile_starts(size, scale)
    assert starts[0] == 0 and starts[-1] + 16 * high >= size
    assert (np.diff(starts) == 14 * high).all()
