"""Statistics and covariance outliers against plain Python and numpy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallgrid.llm import outliers as o

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def failed(c):
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def vector(c):
    ratios = [(c[1] + 100) / (c[0] + 20), *(x / (c[0] + 20) for x in c[2:])]
    return [math.floor(256 * math.sqrt(r) + 0.5) for r in ratios]


def distances(points, means, cov):
    away = points - means
    return np.einsum("ij,ij->i", away @ np.linalg.inv(cov), away)


def fitted(points):
    """Plain concentration steps from two starts, with the operator's bands and floors, by matrix algebra."""
    floor, best = np.diag([25.6 ** 2] * 4), None
    q = np.percentile(points, [25, 50, 75], axis=0)
    for start in (1, 2):
        means, cov = q[1], np.diag(((q[2] - q[0]) * 0.7413) ** 2) + floor
        for step in range(o.STEPS):
            band = np.minimum(np.floor(32 * np.sqrt(distances(points, means, cov))), 4096)
            before = np.searchsorted(np.sort(band), band)
            chosen = points[before * 4 < len(points) * (2 if start == 2 and step == 0 else 3)]
            means, cov = chosen.mean(0), np.cov(chosen.T, bias=True) + floor
        if best is None or np.linalg.det(cov) < best[0] * (1 - 1e-9):
            best = np.linalg.det(cov), means, cov
    band = np.minimum(np.floor(32 * np.sqrt(distances(points, *best[1:]))), 4096)
    middle = np.sort(band)[(len(points) - 1) // 2]
    chosen = points[(band / 32) ** 2 / max(1, ((middle + 0.5) / 32) ** 2 / o.MEDIAN) <= o.NEAR]
    return chosen.mean(0), np.cov(chosen.T, bias=True) + floor


def expected(rows, least):
    """Sorted (id, counts, failed, distance, kept)."""
    own = [(i, lang, source, counts(text)) for i, text, lang, source in rows]
    good = [r for r in own if not failed(r[3])]
    sizes = Counter((r[1], r[2]) for r in good)
    others = Counter()
    for (lang, _), n in sizes.items():
        others[lang] += n if n < least else 0
    def pool(lang, source):
        return (lang, source) if sizes[lang, source] >= least else (lang,) if others[lang] >= least else ()
    pools = {}
    for _, lang, source, c in good:
        pools.setdefault(pool(lang, source), []).append(vector(c))
    fits = {p: fitted(np.array(v, float)) for p, v in pools.items() if len(v) >= least}
    out = []
    for i, lang, source, c in own:
        fit = None if failed(c) else fits.get(pool(lang, source))
        d = None if fit is None else float(distances(np.array([vector(c)], float), *fit)[0])
        out.append((i if i is not None else -1, c, failed(c), d, not failed(c) and (d is None or d <= o.CUTOFF)))
    return sorted(out, key=lambda r: (r[0], r[1], r[3] or 0))


def assessed(spark, rows, least):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                               "doc_id long, text string, lang string, source string, _id int, pool string, band int")
    out = [(r["_id"] if r["_id"] is not None else -1, tuple(r[f] for f in FIELDS), r["base_failed"], r["distance"], r["kept"])
           for r in o.assess(df, least=least).collect()]
    return sorted(out, key=lambda r: (r[0], r[1], r[3] or 0))


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[4] == b[4]
        assert (a[3] is None) == (b[3] is None) and (a[3] is None or a[3] == pytest.approx(b[3], rel=1e-6))


def writer(g):
    common = ["".join(g.choice("abcdeé") for _ in range(g.randint(1, 9))) for _ in range(400)]

    def text(n, junk=0.0):
        words = [g.choice(common) + (g.choice(["###", "&&", "|"]) if g.random() < junk else "") for _ in range(n)]
        for k in range(7, n, 11):
            words[k] += g.choice(["\n", ".", "", ""])
        return g.choice([" ", "\t", "  "]).join(words)
    return text


def test_equals_plain_estimates(spark, odd_rows):
    g = random.Random(21)
    text = writer(g)
    rows = [(i, text(g.randint(5, 200), 0.6 if i % 9 == 0 else 0.01), g.choice(["en", "fr"]), g.choice(["a", "b", "c", None]))
            for i in range(700)]
    rows += [(1000 + i, text(60), None, "a") for i in range(80)]  # a null language
    rows += [(1200 + i, text(60), "de", f"s{i}") for i in range(60)]  # sources too small alone
    rows += [(1300 + i, text(30), f"l{i}", "a") for i in range(20)]  # languages too small alone
    rows += [(2000 + i, "one line again\n" * 3 + text(100), "en", "a") for i in range(5)]
    rows += [(i, t, "en", "a") for i, t in odd_rows] + rows[:4]
    got, want = assessed(spark, rows, 50), expected(rows, 50)
    same(got, want)
    kept = {r[0]: r[4] for r in got}
    assert sum(kept[i] for i in range(0, 700, 9)) < 8 and sum(kept[i] for i in range(700)) > 500
    assert all(r[3] is None and r[4] for r in got if 1300 <= r[0] < 1320)


def test_one_vector_most_of_the_time_and_empty_tables(spark):
    g = random.Random(22)
    text = writer(g)
    line = text(40)
    rows = [(i, line, "en", "a") for i in range(300)] + [(500 + i, text(40, 1.0), "en", "a") for i in range(40)]
    got = assessed(spark, rows, 100)
    same(got, expected(rows, 100))
    assert all(r[4] == (r[0] < 500) for r in got)
    assert assessed(spark, [], 100) == []
    same(assessed(spark, rows[:3], 100), expected(rows[:3], 100))


def test_the_query_runs_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = o.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert plan.count("split(") <= 2  # lines and words are split once each
