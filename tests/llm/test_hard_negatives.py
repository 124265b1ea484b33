"""Hard negatives against brute force, and subset sums against plain inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrid.llm import hard_negatives as h

SCHEMA = "vec_id long, label int, embedding array<double>, _id string, _label int, anchor long"


def brute(rows, every=10, positives=5, negatives=10):
    own = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None
           and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in sorted({(i, lab, tuple(v)) for i, lab, v in own if i % every == 0}):
        scored = sorted((-sum(map(int.__mul__, v, w)), j, other) for j, other, w in own if len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == lab and s[1] != i][:positives]:
            near = [s for s in scored if s[2] != lab and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:negatives]
            out += [(i, p, rank, j, -ps, -s) for rank, (s, j, _) in enumerate(near, start=1)]
    return sorted(out)


def mined(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, h.mine(df, F.col("vec_id") % 10 == 0, **settings).collect()))


@pytest.mark.parametrize("batch", [4096, 3])
def test_equals_brute_force_with_odd_rows(spark, batch):
    g = random.Random(3)
    rows = [(i, g.randrange(3), [g.gauss(0.1, 0.5) for _ in range(11)]) for i in range(120)]
    rows += [(200 + i, g.randrange(3), [g.gauss(0.5, 30) for _ in range(3)]) for i in range(30)]  # another length
    rows += [(300 + i, i % 2, [0.25] * 11) for i in range(40)]  # one vector many times: ties go to smaller ids
    rows += [rows[10], rows[10], rows[7], (20, 2, rows[30][2])]  # repeated rows, one id with two labels
    rows += [(400, None, [1.0] * 11), (401, 1, None), (402, 1, [1.0, None] * 5 + [1.0]), (410, 1, [math.nan] * 11),
             (None, 1, [1.0] * 11), (412, 1, [math.inf] * 11), (420, 1, [0.0] * 11), (421, 1, []), (430, 1, []), (431, 0, [])]
    want = brute(rows)
    assert len(want) > 300 and mined(spark, rows, batch=batch) == want


def test_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0, 2.0])]) == []


@pytest.mark.parametrize("spread", [1, 300, 1 << 20])
def test_subset_sums_are_inner_products(spread):
    g = np.random.default_rng(spread)
    for size in (1, 8, 13, 64):
        anchors, rows = g.integers(-spread, spread + 1, (5, size)), g.integers(-spread, spread + 1, (1030, size))
        assert (h.SubsetSums(anchors).scores(h.planes_of(rows)) == anchors @ rows.T).all()
