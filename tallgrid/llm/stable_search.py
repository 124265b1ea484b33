"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected on ``AXES`` Gaussian directions: a projected squared distance, divided by the true one, follows a
chi-square law with that many degrees of freedom. Each block of at most about ``BLOCK`` vectors holds its projections in a
kd-tree. A query takes the block's leaves in order of projected distance, verifies true distances, and stops as soon as any
vector still as near as its k-th best would have shown up already with probability ``SURE``. The best of all blocks are merged.

Equal vectors of a block are one point with a list of ids, so a vector that a third of the rows share is verified once. Queries
go to the blocks in batches of at most about ``QUERIES``, so what is broadcast has that bound.

Defined cases: null vectors, vectors with null or non-finite components and zero vectors take no part; vectors are compared
with those of the same length only; repeated rows are candidates each, a query's own id is not; ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrid.llm.shared import keep, prepare

AXES, LEAF, BLOCK, QUERIES, SURE = 8, 256, 16_384, 8_192, 0.97


def chi_square(x: np.ndarray, degrees: int = AXES) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = np.asarray(x, float) / 2, 1.0, 1.0
    for k in range(1, degrees // 2):
        term = term * half / k
        total = total + term
    return 1.0 - np.exp(-half) * total


def _bar() -> float:
    """The chi-square value that is reached with probability ``SURE``."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < SURE else (low, mid)
    return high


def directions(dimension: int) -> np.ndarray:
    return np.random.default_rng(dimension).standard_normal((dimension, AXES))


class Tree:
    """A kd-tree over points, split at medians down to leaves; yields leaves by rising distance."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.low, self.high, self.spans, self.children = [], [], [], []
        self._build(points, 0, len(points))
        self.low, self.high, self.points = np.array(self.low), np.array(self.high), points[self.order]

    def _build(self, points: np.ndarray, a: int, b: int) -> int:
        own, node = points[self.order[a:b]], len(self.spans)
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.spans.append((a, b))
        self.children.append(None)
        if b - a > LEAF:
            axis, mid = int(np.argmax(self.high[node] - self.low[node])), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            self.children[node] = (self._build(points, a, a + mid), self._build(points, a + mid, b))
        return node

    def leaves(self, query: np.ndarray):
        """(least squared distance, first, end) of leaves, rising: no later leaf is nearer than an earlier one."""
        away = np.maximum(np.maximum(self.low - query, query - self.high), 0.0)
        gaps = (away * away).sum(1).tolist()
        nodes = [(gaps[0], 0)]
        while nodes:
            gap, node = heapq.heappop(nodes)
            if self.children[node] is None:
                yield gap, *self.spans[node]
            else:
                for child in self.children[node]:
                    heapq.heappush(nodes, (gaps[child], child))


class Block:
    """Vectors of one length with their ids, equal vectors joined, in the order of the tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        vectors = np.ascontiguousarray(vectors + 0.0)  # no negative zero
        raw = vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).reshape(-1)
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        self.axes = directions(vectors.shape[1])
        self.tree = Tree(vectors[first] @ self.axes)
        place = np.empty(len(first), np.int64)
        place[self.tree.order] = np.arange(len(first))
        order = np.lexsort((ids, place[which]))
        self.ids, self.cuts = ids[order], np.append(0, np.cumsum(np.bincount(place[which])))
        self.vectors = vectors[first][self.tree.order]

    def search(self, own: int, query: np.ndarray, k: int, bar: float) -> list[tuple[float, int]]:
        """The ``k`` nearest ids found; leaves are verified by rising projected distance until the test holds."""
        projected = query @ self.axes
        away, points, limit = np.zeros(0), np.zeros(0, np.int64), np.inf
        for gap, a, b in self.tree.leaves(projected):
            reach = bar * limit ** 2
            if gap > reach:
                break
            at = np.arange(a, b)
            if limit < np.inf:
                at = at[((self.tree.points[a:b] - projected) ** 2).sum(1) <= reach]
            found = np.sqrt(((self.vectors[at] - query) ** 2).sum(1))
            if (found == 0).any():  # the query's own row is no candidate
                same = at[found == 0][0]
                if (self.ids[self.cuts[same]:self.cuts[same + 1]] == own).all():
                    at, found = at[found > 0], found[found > 0]
            away, points = np.append(away, found), np.append(points, at)
            if len(away) >= k:
                limit = np.partition(away, k - 1)[k - 1]
                away, points = away[away <= limit], points[away <= limit]
        best = []
        for distance, p in zip(away.tolist(), points.tolist()):
            # of equal vectors only the k least other ids can be among the best
            some = self.ids[self.cuts[p]:self.cuts[p + 1]]
            repeats = np.searchsorted(some, own, "right") - np.searchsorted(some, own)
            best += [(distance, i) for i in some[:k + repeats].tolist() if i != own]
        return sorted(best)[:k]


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``_id`` and ``_vector`` (doubles) of the vectors that take part."""
    vector = F.col(vector_column).cast("array<double>")
    rows = table.select(F.col(id_column).cast("long").alias("_id"), vector.alias("_vector")).where(
        "_id is not null and _vector is not null")
    odd = F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd & F.exists("_vector", lambda x: x != 0))


def nearest(table: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
            k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` (Euclidean distance) of the ``k`` nearest rows of ``table``."""
    spark = table.sparkSession
    prepare(spark)
    rows = keep(usable(table, id_column, vector_column))
    total = rows.count()
    n_blocks = max(1, -(-total // BLOCK))
    wanted = usable(queries, id_column, vector_column).distinct()
    n_batches = max(1, -(-wanted.count() // QUERIES))
    part = lambda column, n, seed: F.pmod(F.xxhash64(F.lit(seed), column), F.lit(n))
    blocks = rows.withColumn("_block", part(F.monotonically_increasing_id(), n_blocks, 1))
    found = None
    for batch in range(n_batches):
        own = [(r[0], np.array(r[1])) for r in wanted.where(part(F.col("_id"), n_batches, 2) == batch).collect()]
        result = blocks.groupBy("_block").applyInArrow(
            _block_search(spark.sparkContext.broadcast(own), k), "query_id long, score double, vec_id long")
        found = result if found is None else found.unionByName(result)
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _block_search(queries, k: int):
    def run(table: pa.Table) -> pa.Table:
        bar, out = _bar(), []
        ids, vectors = table.column("_id").to_numpy(), table.column("_vector").combine_chunks()
        flat, cuts = vectors.flatten().to_numpy(), vectors.value_lengths().to_numpy().astype(np.int64)
        begin = np.cumsum(cuts) - cuts
        for size in np.unique(cuts).tolist():
            at = np.flatnonzero(cuts == size)
            block = Block(ids[at], flat[begin[at][:, None] + np.arange(size)])
            for own, query in queries.value:
                if len(query) == size:
                    out += [(own, d, i) for d, i in block.search(own, query, k, bar)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()),
                         pa.array(columns[2], pa.int64())], ["query_id", "score", "vec_id"])

    return run
