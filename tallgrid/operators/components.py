"""Connected components as a few rounds of joins on a small graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid.session import cut

TILE_ROWS, TILE_COLS = 512, 64
NODE_COLUMNS = 1 << 31  # a column index is an int, so a row and a column make one long


def label_components(edges: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, node, label) for every node that has an edge; the label is the smallest node of its component. None: no edges.

    ``edges``: keys, a, b. Alternates two star operations (every node points its larger neighbours, then its smaller
    ones, at the smallest neighbour) until nothing changes. A hub is reduced by partial aggregation; the join back
    is an equi-join whose skewed partitions the adaptive planner splits. Each round ends in a reliable checkpoint.
    """
    pairs = cut(edges.select(*keys, F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                .filter("hi <> lo").distinct())
    known = _fingerprint(pairs, keys)
    if not known[0]:
        return None
    while True:
        both = pairs.select(*keys, F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select(*keys, F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, [*keys, "u"]).filter("v > u")
                 .select(*keys, F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct())
        lowest = large.groupBy(*keys, "hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, [*keys, "hi"]).filter("lo <> m").select(*keys, F.col("lo").alias("hi"),
                                                                          F.col("m").alias("lo"))
        small = moved.unionByName(lowest.select(*keys, "hi", F.col("m").alias("lo"))).distinct()
        pairs = cut(small)
        now = _fingerprint(pairs, keys)
        if now == known:
            break
        known = now
    labels = pairs.select(*keys, F.col("hi").alias("node"), F.col("lo").alias("label"))
    return labels.unionByName(pairs.select(*keys, F.col("lo").alias("node"), F.col("lo").alias("label"))).distinct()


def _fingerprint(pairs: DataFrame, keys: list[str]) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "hi", "lo").cast("decimal(20,0)")),
                    F.sum(F.col("lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def _local_components(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The first cell of each cell's 4-neighbour component, for distinct cells sorted by row and column."""
    n = len(rows)
    code = rows * NODE_COLUMNS + cols
    below = np.searchsorted(code, code + NODE_COLUMNS)
    down = np.flatnonzero((below < n) & (code[np.minimum(below, n - 1)] == code + NODE_COLUMNS))
    run = np.cumsum(np.append(1, code[1:] != code[:-1] + 1)) - 1  # cells side by side
    upper, lower, label = run[down], run[below[down]], np.arange(run[-1] + 1)
    while True:
        low = np.minimum(label[upper], label[lower])
        new = label.copy()
        for side in (upper, lower):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    return first[label][run]


def tile_components(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The components inside each tile of ``TILE_ROWS`` by ``TILE_COLS`` cells, one group of the function each.

    Per component: keys, node (its first cell), r0, r1, c0, c1, the cells beyond the tile's lower and right border that it
    would touch (``beyond``) and its own cells on the upper and left border (``border``).
    """
    named = [f"{k} {dict(cells.dtypes)[k]}" for k in keys]

    def label(key, table):
        rows, cols = (table.column(c).to_numpy().astype(np.int64) for c in ("row_idx", "col_idx"))
        order = np.lexsort((cols, rows))
        distinct = np.unique(rows[order] * NODE_COLUMNS + cols[order])
        rows, cols = distinct // NODE_COLUMNS, distinct % NODE_COLUMNS
        first = _local_components(rows, cols)
        order = np.argsort(first, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(first[order]) > 0))
        low = lambda x: np.minimum.reduceat(x[order], starts)
        high = lambda x: np.maximum.reduceat(x[order], starts)
        at = first[order][starts]

        def lists(*parts):
            owner, codes = (np.concatenate(x) for x in zip(*parts))
            back = np.argsort(owner, kind="stable")
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[back], np.append(at, len(first))), pa.int32()),
                                            pa.array(codes[back], pa.int64()))

        bottom, right = rows % TILE_ROWS == TILE_ROWS - 1, cols % TILE_COLS == TILE_COLS - 1
        top, left = (rows % TILE_ROWS == 0) & (rows > 0), (cols % TILE_COLS == 0) & (cols > 0)
        columns = [pa.repeat(scalar, len(at)) for scalar in key[:len(keys)]]
        columns += [pa.array(x, pa.int64()) for x in (distinct[at], low(rows), high(rows), low(cols), high(cols))]
        columns += [lists((first[bottom], distinct[bottom] + NODE_COLUMNS), (first[right], distinct[right] + 1)),
                    lists((first[top | left], distinct[top | left]))]
        return pa.table(columns, names=[*keys, "node", "r0", "r1", "c0", "c1", "beyond", "border"])

    schema = ", ".join([*named, *(f"{c} long" for c in ("node", "r0", "r1", "c0", "c1")), "beyond array<long>", "border array<long>"])
    tile = [F.floor(F.col(c) / n).alias(t) for c, n, t in (("row_idx", TILE_ROWS, "_tr"), ("col_idx", TILE_COLS, "_tc"))]
    return cells.select(*keys, "row_idx", "col_idx", *tile).groupBy(*keys, "_tr", "_tc").applyInArrow(label, schema)


def component_boxes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding boxes (keys, r0, r1, c0, c1) of the 4-neighbour components of ``cells`` per key.

    Tiles are labelled first; only contacts across tile borders are labelled in rounds, so these depend on how far a component
    winds through tiles, not on the height of a sheet. A component inside one tile takes no round.
    """
    parts = cut(tile_components(cells, keys))
    across = parts.select(*keys, F.col("node").alias("a"), F.explode("beyond").alias("at")).join(
        parts.select(*keys, F.col("node").alias("b"), F.explode("border").alias("at")), [*keys, "at"])
    labels = label_components(across.select(*keys, "a", "b"), keys)
    named = parts if labels is None else parts.join(labels, [*keys, "node"], "left").withColumn(
        "node", F.coalesce("label", "node"))
    return named.groupBy(*keys, "node").agg(
        F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("node")
