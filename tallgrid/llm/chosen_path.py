"""MinHash near-dedup: chosen-path join of shingle sets.

A document's set holds its distinct shingles of ``words`` lower-cased words. Documents with equal sets are one vertex. Each of
``TREES`` independent trees branches the vertices recursively: a node selects one token of each set, the least under the
node's own hash, and the token names the child. Nodes of at most ``NODE`` vertices and ``NODE_SHINGLES`` shingles are compared
exhaustively: sketches of one
byte per selected token leave plausible partners (a linked pair fails that test about once in 10^7), and full sets confirm
every link. Nodes that stay larger after ``DEPTH`` levels are mostly near copies of each other; they are compared in blocks
that all meet the node's pivots, and vertices that no pivot reaches become the next pivots, as long as that pays. What may be
linked then but lies in different components is joined exactly: of two linked sets, the rarest shingles, ``1 - J`` of each set
and one more, have one in common, so each such shingle is a node, compared exhaustively in pairs of blocks if it is large.
The exact join takes every vertex that branched in any tree, so branching costs no recall: a pair is only missed if one of
the two never branched and all trees part them at the first level.

A pair at the threshold is missed with probability (1 - J)^trees of at most ``MISS``; ``TREES`` trees are the least.

Defined cases: a null or blank text has an empty set and is linked with nothing; fewer words than a shingle make one shingle
of the whole sequence; equal rows are equal vertices; a null id comes after all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid.llm import graph, rolling, spans
from tallgrid.llm.shared import keep, partitions, prepare, tasks_for

TREES, DEPTH = 10, 5
NODE, NODE_SHINGLES = 4096, 1 << 21
PIVOTS = 32
#: rounds of pivots go on while one settles this part of the vertices that were left
WORTHWHILE = 0.1
#: counters that tell common shingles from rare ones; any order of shingles is exact, this one only keeps nodes small
SLOT_BITS = 18
SKETCH = TREES * DEPTH
#: the chance to miss a pair at the threshold, by the trees and by the sketches each
MISS = 2e-7

SIGNATURE = "_id long, _key int, v binary, n_shingles long, paths array<long>, sketch binary"


def trees_for(percent: int) -> int:
    """Trees that part a pair at the threshold at their first level with probability ``MISS`` at most."""
    return max(TREES, math.ceil(math.log(MISS) / math.log1p(-percent / 100))) if percent < 100 else TREES


def least_matches(percent: int) -> int:
    """Matches among the sketch bytes that a pair at the threshold reaches but for ``MISS``."""
    p, below = percent / 100, 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * p**k * (1 - p)**(SKETCH - k)
        if below > MISS:
            return k
    return SKETCH


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and where each document's begin."""
    lowered = rolling.LOWER[data]
    _, _, values, limits = rolling.words(lowered, bounds)
    prefix = rolling.Prefix(values)
    shingles = prefix.windows(width)
    sets = []
    for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
        if b - a >= width:
            part = np.sort(shingles[a:b - width + 1])
            sets.append(part[np.append(True, part[1:] != part[:-1])])
        elif b > a:
            sets.append(prefix.ranges(np.array([a]), np.array([b])))
        else:
            sets.append(shingles[:0])
    starts = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=starts[1:])
    return (np.concatenate(sets) if sets else shingles[:0]), starts


def signatures(documents: DataFrame, width: int, trees: int = TREES) -> DataFrame:
    """Set size, set fingerprint ``v`` and the selected token of every tree and level, as paths and as a sketch."""
    selected = trees * DEPTH
    seeds = rolling.mix(np.arange(1, selected + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def apply(batches):
        for batch in batches:
            ids, keys = batch.column("_id"), batch.column("_key")
            for row, data, bounds in rolling.slices(batch.column("_text")):
                tokens, starts = shingle_sets(data, bounds, width)
                sizes = np.diff(starts)
                full = np.flatnonzero(sizes)
                at = starts[:-1][full]
                paths = np.zeros((len(sizes), selected), np.uint64)
                sketch = np.zeros((len(sizes), SKETCH), np.uint8)
                prints = np.zeros((len(sizes), 2), np.uint64)
                if len(full):
                    prints[full, 0] = np.add.reduceat(tokens, at)
                    prints[full, 1] = np.bitwise_xor.reduceat(tokens * np.uint64(0xD6E8FEB86659FD93), at)
                    for k in range(selected):
                        low = np.minimum.reduceat(tokens * seeds[k], at)
                        rolling.mix(low)
                        if k < SKETCH:
                            sketch[full, k] = low.astype(np.uint8)
                        parent = paths[full, k - 1] if k % DEPTH else np.full(len(full), k + 1, np.uint64)
                        paths[full, k] = rolling.mix(low ^ parent * np.uint64(0x9FB21C651E98DF25))
                n = len(sizes)
                flat = pa.array(paths.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), keys.slice(row, n), pa.array([p.tobytes() for p in prints], pa.binary()),
                     pa.array(sizes), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * selected, flat),
                     pa.array([s.tobytes() for s in sketch], pa.binary())],
                    ["_id", "_key", "v", "n_shingles", "paths", "sketch"])

    return documents.select("_id", "_key", "_text").mapInArrow(apply, SIGNATURE)


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``column`` in tables that split no group, with the first row of each group and an end mark."""
    rest: pa.Table | None = None

    def marked(table):
        values = table.column(column).to_numpy()
        return table, np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        values = table.column(column).to_numpy()
        last = int(np.flatnonzero(values != values[-1])[-1]) + 1 if (values != values[-1]).any() else 0
        rest = table.slice(last)
        if last:
            yield marked(table.slice(0, last).combine_chunks())
    if rest is not None:
        yield marked(rest.combine_chunks())


def likely(sketch: np.ndarray, sizes: np.ndarray, least: int, percent: int, comps: np.ndarray | None = None) -> np.ndarray:
    """Matrix of pairs that may be linked, by sizes and sketches; with ``comps`` only pairs of different components."""
    n = len(sizes)
    out = np.zeros((n, n), bool)
    for i in range(n - 1):
        rest = slice(i + 1, n)
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        near = 100 * small >= percent * large
        if comps is not None:
            near &= comps[rest] != comps[i]
        if near.any():
            near &= (sketch[rest] == sketch[i]).sum(1) >= least
            out[i, rest] = out[rest, i] = near
    return out


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _comps(table: pa.Table) -> np.ndarray | None:
    return table.column("comp").to_numpy() if "comp" in table.column_names else None


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "node").coalesce(tasks).sortWithinPartitions("node")


def plausible_members(nodes: DataFrame, percent: int, tasks: int) -> DataFrame:
    """The rows of (``node``, ``v``, ``n_shingles``, ``sketch``) with a plausible partner in their node."""
    least = least_matches(percent)

    def apply(batches):
        for table, cuts in whole_groups(batches, "node"):
            sketch, sizes = _sketches(table.column("sketch")), table.column("n_shingles").to_numpy()
            keep_rows, comps = np.zeros(table.num_rows, bool), _comps(table)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a > 1:
                    own = None if comps is None else comps[a:b]
                    keep_rows[a:b] = likely(sketch[a:b], sizes[a:b], least, percent, own).any(1)
            yield from table.filter(pa.array(keep_rows)).to_batches()

    return _dealt(nodes, tasks).mapInArrow(apply, nodes.schema)


def confirmed_links(members: DataFrame, texts: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """Links (``a``, ``b``) that full sets confirm, enough to connect what is linked inside each node."""
    least = least_matches(percent)
    dealt = _dealt(members.join(texts, "v"), tasks)

    def of_node(part):
        sizes, sketch = part.column("n_shingles").to_numpy(), _sketches(part.column("sketch"))
        pairs, label = likely(sketch, sizes, least, percent, _comps(part)), np.arange(part.num_rows)
        data, starts = [], [0]
        for _, piece, bounds in rolling.slices(part.column("_text").combine_chunks()):
            tokens, at = shingle_sets(piece, bounds, width)
            data.append(tokens)
            starts.extend((starts[-1] + at[1:]).tolist())
        tokens, starts = np.concatenate(data), np.array(starts)
        _, tokens = np.unique(tokens, return_inverse=True)
        present = np.zeros(int(tokens.max()) + 1, bool)
        # those with most plausible partners first: one of them connects most of a group of copies
        for i in np.argsort(-pairs.sum(1), kind="stable"):
            others = np.flatnonzero(pairs[i] & (label != label[i]))
            if not len(others):
                continue
            present[tokens[starts[i]:starts[i + 1]]] = True
            for j in others:
                if label[j] != label[i]:
                    common = int(np.count_nonzero(present[tokens[starts[j]:starts[j + 1]]]))
                    if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                        yield i, j
                        label[label == label[j]] = label[i]
            present[tokens[starts[i]:starts[i + 1]]] = False

    def apply(batches):
        for table, cuts in whole_groups(batches, "node"):
            vertex, left, right = table.column("v").to_pylist(), [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for i, j in of_node(table.slice(a, b - a)) if b - a > 1 else ():
                    left.append(vertex[a + i])
                    right.append(vertex[a + j])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return dealt.mapInArrow(apply, "a binary, b binary")


def branched(vertices: DataFrame, tasks: int,
             trees: int = TREES) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The nodes of every tree that are small enough, what is still larger at the last level, and every vertex whose first
    node is larger in some tree (None if nothing)."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = vertices.select("v", "n_shingles", "sketch", "paths", tree.alias("tree"))
    rows = rows.select("v", "n_shingles", "sketch", F.slice("paths", F.col("tree") * DEPTH + 1, DEPTH).alias("path"))
    small = (F.col("size") <= NODE) & (F.col("shingles") <= NODE_SHINGLES)
    done = hot = None
    for level in range(DEPTH):
        rows = rows.withColumn("node", F.col("path")[level])
        sizes = keep(rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"))
                     .where("size > 1"), tasks)
        # both sides are tables, so a hot node's rows can be split
        rows = keep(rows.drop("size", "shingles").join(sizes, "node"), tasks)
        part = rows.where(small).select("node", "v", "n_shingles", "sketch")
        done = part if done is None else done.unionByName(part)
        if sizes.where(~small).isEmpty():
            return done, None, hot
        rows = rows.where(~small)
        if level == 0:
            hot = keep(rows.select("v", "n_shingles", "sketch").dropDuplicates(["v"]), tasks)
    return done, rows, hot


def in_blocks(large: DataFrame, state: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """One round on nodes that no level made small: (blocks as nodes, pivots).

    ``state`` has the vertices of ``large`` that no pivot has reached, by node. Every block of a node meets its pivots.
    """
    parts = F.greatest(F.ceil(F.col("size") / NODE), F.ceil(F.col("shingles") / NODE_SHINGLES))
    slot = F.pmod(F.xxhash64("v", F.lit(7)), F.lit(PIVOTS))
    pivots = keep(state.groupBy("node", slot.alias("slot")).agg(F.min("v").alias("v")).select("node", "v"), tasks)
    blocked = large.withColumn("block", F.pmod(F.xxhash64("v", "node"), parts))
    everywhere = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    pivot_rows = large.join(pivots, ["node", "v"]).withColumn("block", everywhere)
    rows = blocked.unionByName(pivot_rows).dropDuplicates(["node", "block", "v"])
    return rows.withColumn("node", F.xxhash64("node", "block")).select("node", "v", "n_shingles", "sketch"), pivots


def frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """How many sets of ``texts`` hold a shingle of each slot, the leading bits of the shingle."""
    def apply(batches):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, data, bounds in rolling.slices(batch.column("_text")):
                tokens, _ = shingle_sets(data, bounds, width)
                total += np.bincount((tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    found = texts.select("_text").mapInArrow(apply, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(``node``, ``v``, ``comp``, ``n_shingles``): the rarest shingles of every set of (``v``, ``comp``, ``_text``), as many
    that two sets of the wanted similarity have one in common."""
    common = texts.sparkSession.sparkContext.broadcast(frequencies(texts, width))

    def apply(batches):
        for batch in batches:
            for row, data, bounds in rolling.slices(batch.column("_text")):
                tokens, starts = shingle_sets(data, bounds, width)
                sizes = np.diff(starts)
                of = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((tokens, common.value[(tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], of))
                wanted = sizes - -(-percent * sizes // 100) + 1
                order = order[np.arange(len(of)) - starts[of] < wanted[of]]
                at = pa.array(row + of[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[order].view(np.int64)), batch.column("v").take(at), batch.column("comp").take(at),
                     pa.array(sizes[of[order]])], ["node", "v", "comp", "n_shingles"])

    return texts.select("v", "comp", "_text").mapInArrow(apply, "node long, v binary, comp long, n_shingles long")


def across_components(vertices: DataFrame, roots: DataFrame, texts: DataFrame, width: int, percent: int,
                      tasks: int) -> DataFrame:
    """Nodes in which every two of ``vertices`` (``v``, ``sketch``) meet that may be linked and have different roots."""
    known = vertices.join(roots, "v", "left").select("v", F.xxhash64(F.coalesce("root", "v")).alias("comp"))
    rows = keep(prefixes(keep(known.join(texts, "v"), tasks), width, percent))
    sizes = rows.groupBy("node").agg(
        F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"), F.min("comp").alias("low"),
        F.max("comp").alias("high"), F.expr("bit_xor(xxhash64(v))").alias("members"))
    # nodes of the same vertices count once
    nodes = keep(sizes.where("low < high").groupBy("size", "shingles", "low", "high", "members")
                 .agg(F.min("node").alias("node")).select("node", "size", "shingles"), tasks)
    rows = keep(rows.join(nodes, "node"))
    small = (F.col("size") <= NODE) & (F.col("shingles") <= NODE_SHINGLES)
    out = rows.where(small).select("node", "v", "comp")
    if not nodes.where(~small).isEmpty():
        # the largest component of a node meets all others, but not itself
        large = rows.where(~small)
        groups = keep(large.groupBy("node", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")), tasks)
        main = groups.groupBy("node").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"),
                                          F.max(F.struct("n", "comp", "s")).alias("most"), F.sum("n").alias("n"),
                                          F.sum("s").alias("s"))
        parts = lambda n, s: F.greatest(F.ceil(2 * n / NODE), F.ceil(2 * s / NODE_SHINGLES))
        main = keep(main.select("node", "main", parts(F.col("most.n"), F.col("most.s")).alias("own"),
                                parts(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("others")), tasks)
        is_main, slot = F.col("comp") == F.col("main"), F.xxhash64("v", "node")
        block = F.when(is_main, F.col("others") + F.pmod(slot, "own")).otherwise(F.pmod(slot, "others"))
        last = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1
        met = large.join(main, "node").withColumn("block", block).withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        out = out.unionByName(met.select(
            F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "v", "comp"))
    return keep(out.join(vertices.select("v", "n_shingles", "sketch"), "v").select("node", "v", "n_shingles", "sketch", "comp"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5,
                    percent: int = 85) -> DataFrame:
    """Per input row: ``_id`` and ``_key`` (see ``spans.keyed``), ``n_shingles``, ``component_id``, the least id of its
    component, and ``root``, a name of the component (null for an empty set)."""
    spark = docs.sparkSession
    prepare(spark)
    documents = spans.keyed(docs, id_column, text_column)
    trees = trees_for(percent)
    rows = keep(signatures(documents, width, trees))
    tasks = tasks_for(rows.count(), spark)
    vertices = keep(rows.where("n_shingles > 0").groupBy("v").agg(
        F.min("_id").alias("least_id"), F.min(F.struct("_id", "_key")).alias("at"), F.first("n_shingles").alias("n_shingles"),
        F.first("paths").alias("paths"), F.first("sketch").alias("sketch")), tasks)
    nodes, large, hot = branched(vertices, tasks, trees)
    members = keep(plausible_members(nodes, percent, tasks), tasks)
    wanted = members.select("v") if hot is None else members.select("v").unionByName(hot.select("v"))
    places = vertices.select("v", "at._id", "at._key").join(wanted.distinct(), "v", "left_semi")
    found = documents.select("_id", "_key", "_text").join(places.hint("shuffle_hash"), ["_id", "_key"])
    texts = keep(found.select("v", "_text").dropDuplicates(["v"]), tasks)
    links = keep(confirmed_links(members, texts, width, percent, tasks), tasks)
    state = large
    while state is not None:
        blocks, pivots = in_blocks(large, state, tasks)
        shown = keep(plausible_members(blocks, percent, tasks), tasks)
        links = keep(links.unionByName(confirmed_links(shown, texts, width, percent, tasks)), tasks)
        roots = graph.components(links, tasks)
        reached = keep(pivots.join(roots, "v", "left").select("node", F.coalesce("root", "v").alias("comp")).distinct(), tasks)
        before = state.count()
        state = keep(state.join(roots, "v", "left").withColumn("comp", F.coalesce("root", "v"))
                     .join(reached, ["node", "comp"], "left_anti").select(large.columns), tasks)
        left = state.count()
        if not left or before - left < WORTHWHILE * before:
            break
    if hot is not None:
        nodes = across_components(hot, graph.components(links, tasks), texts, width, percent, tasks)
        shown = keep(plausible_members(nodes, percent, tasks), tasks)
        links = keep(links.unionByName(confirmed_links(shown, texts, width, percent, tasks)), tasks)
    roots = graph.components(links, tasks)
    # vertices that are linked: the least id of their component
    ends = roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
    linked = keep(ends.join(vertices.select("v", "least_id"), "v"), tasks)
    least = keep(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), tasks)
    labels = keep(linked.join(least, "root").select("v", "root", "component_id"), tasks)
    classes = vertices.select("v", "least_id").join(labels, "v", "left").select(
        "v", F.coalesce("root", "v").alias("root"), F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.select("_id", "_key", "v", "n_shingles").join(classes, "v", "left").select(
        "_id", "_key", "n_shingles", F.coalesce("component_id", "_id").alias("component_id"), "root")


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component the row with the least id (of equal ids, the least
    text hash) stays, once; rows with an empty set all stay. Columns are unchanged."""
    found = keep(near_duplicates(docs, id_column, text_column, width, percent))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("_id", "_key")).alias("at"))
    kept = first.select("at._id", "at._key").unionByName(found.where("root is null").select("_id", "_key").distinct())
    documents = spans.keyed(docs, id_column, text_column)
    rows = documents.select("_id", "_key", "_row").join(kept.hint("shuffle_hash"), ["_id", "_key"])
    repeated = found.where("root is not null").groupBy("_id", "_key").count().where("count > 1")
    if not repeated.isEmpty():
        once = rows.join(repeated.select("_id", "_key"), ["_id", "_key"]).dropDuplicates(["_id", "_key"])
        rows = rows.join(repeated.select("_id", "_key"), ["_id", "_key"], "left_anti").unionByName(once)
    return rows.select("_row.*")
