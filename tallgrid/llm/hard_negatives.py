"""Hard-negative mining with full scores by the method of the Four Russians.

Components become integers, ``floor(scale * x)``. Every candidate is packed once into bit planes: one byte for each group of
eight dimensions and each bit of the two's complement. For the anchors of a block, a table gives the sum of any subset of the
eight components of a group; a plane's byte is its index. A score is the lookups of each plane summed over the groups, then
added with shifts over the planes, the topmost counting negative: the exact integer inner product, without multiplications.

Anchors go to all candidates in batches of at most ``BATCH``, so that what is collected and broadcast has that bound; candidates
stay where they are. A first pass finds each anchor's positives, a second the negatives in the score range that each positive
score sets. Both keep the best of a task's rows only, and the tasks' bests are ranked.

Defined cases: rows with a null id, label or vector, with a null or non-finite component or one whose integer has more than
``BITS`` bits take no part; zero vectors do. Vectors are compared with those of the same length only. Other rows are those of
another id; equal rows are candidates each, equal anchor rows are one anchor. Ties go to the smaller id. Anchors without
positives, and positives without a row in range, give no rows. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrid.llm.shared import keep, prepare

BATCH, BLOCK, GROUP, BITS, DIMENSIONS = 4096, 256, 8, 24, 1 << 14
PACKED = "_id long, _label long, _size int, _planes binary"
FOUND = "anchor long, positive_score long, score long, other long"
RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of integer rows, [row, plane, group] bytes; the last plane is the sign."""
    rows, size = values.shape
    padded = np.zeros((rows, -(-size // GROUP) * GROUP), np.int64)
    padded[:, :size] = values
    widest = max(int(values.max(initial=0)), -1 - int(values.min(initial=0)))
    bits = [np.packbits((padded >> b) & 1 == 1, axis=1, bitorder="little") for b in range(widest.bit_length() + 1)]
    return np.ascontiguousarray(np.stack(bits, axis=1))


class SubsetSums:
    """Tables of a block of anchors: entry [group, byte] holds for each anchor the sum of the components that the byte selects."""

    def __init__(self, anchors: np.ndarray):
        n, size = anchors.shape
        groups = -(-size // GROUP)
        padded = np.zeros((groups * GROUP, n), np.int64)
        padded[:size] = anchors.T
        self.reach = int(np.abs(anchors).sum(axis=1).max(initial=0))
        self.tables = np.zeros((groups, 1 << GROUP, n), np.int32 if self.reach < 1 << 31 else np.int64)
        for bit in range(GROUP):
            half = 1 << bit
            self.tables[:, half:2 * half] = self.tables[:, :half] + padded[bit::GROUP, None].astype(self.tables.dtype)

    def scores(self, planes: np.ndarray) -> np.ndarray:
        """Inner products [anchor, row] with the rows of ``planes``."""
        rows, n_planes, groups = planes.shape
        kind = np.int32 if self.reach << n_planes < 1 << 31 else np.int64
        out = np.zeros((rows, self.tables.shape[2]), kind)
        for low in range(0, rows, 512):
            part, own = planes[low:low + 512], out[low:low + 512]
            for plane in reversed(range(n_planes)):
                own <<= 1
                add = np.subtract if plane == n_planes - 1 else np.add
                for group in range(groups):
                    add(own, self.tables[group].take(part[:, plane, group], axis=0), out=own, casting="unsafe")
        return np.ascontiguousarray(out.T)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores with their ids, highest first, ties to smaller ids."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[scores >= bar], ids[scores >= bar]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Bests:
    """The best rows so far of each key."""

    def __init__(self, k: int):
        self.k, self.have = k, {}

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.have:
            old, names = self.have[key]
            if len(old) == self.k:
                near = scores >= old[-1]
                scores, ids = scores[near], ids[near]
            scores, ids = np.append(old, scores), np.append(names, ids)
        if len(scores):
            self.have[key] = best(scores, ids, self.k)

    def table(self) -> pa.RecordBatch:
        rows = [(key, *pair) for key, (scores, ids) in self.have.items() for pair in zip(scores.tolist(), ids.tolist())]
        columns = [[r[0][0] for r in rows], [r[0][1] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                          ["anchor", "positive_score", "score", "other"])


def packed(rows: DataFrame, scale: float) -> DataFrame:
    """``_id``, ``_label``, ``_size`` and ``_planes`` of the rows that ``usable`` gives."""
    def apply(batches):
        for batch in batches:
            ids, labels, vectors = batch.column("_id"), batch.column("_label"), batch.column("_vector")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends, flat = np.cumsum(sizes), np.floor(vectors.flatten().to_numpy() * scale).astype(np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                blobs = [p.tobytes() for p in planes_of(flat[(ends[at] - size)[:, None] + np.arange(size)])]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), labels.take(pa.array(at)),
                                                  pa.array(np.full(len(at), size, np.int32)), pa.array(blobs, pa.binary())],
                                                 ["_id", "_label", "_size", "_planes"])

    return rows.select("_id", "_label", "_vector").mapInArrow(apply, PACKED)


def usable(table: DataFrame, id_column: str, label_column: str, vector_column: str, scale: float) -> DataFrame:
    """``_id``, ``_label`` and ``_vector`` (doubles) of the rows that take part."""
    rows = table.select(F.col(id_column).cast("long").alias("_id"), F.col(label_column).cast("long").alias("_label"),
                        F.col(vector_column).cast("array<double>").alias("_vector"))
    odd = F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) >= float(1 << BITS)))
    return rows.where("_id is not null and _label is not null and _vector is not null").where(
        ~odd & (F.size("_vector") <= DIMENSIONS))


def _scored(candidates: DataFrame, anchors, k: int, take) -> DataFrame:
    """The tasks' bests: ``take(bests, anchor, scores, ids, labels)`` picks from the scores of one anchor."""
    def apply(batches):
        blocks, bests = {}, Bests(k)
        for size in {len(a["vector"]) for a in anchors.value}:
            own = [a for a in anchors.value if len(a["vector"]) == size]
            blocks[size] = [(part, SubsetSums(np.array([a["vector"] for a in part], np.int64).reshape(len(part), size)))
                            for part in (own[i:i + BLOCK] for i in range(0, len(own), BLOCK))]
        for batch in batches:
            ids, labels = batch.column("_id").to_numpy(), batch.column("_label").to_numpy()
            sizes, blobs = batch.column("_size").to_numpy(), batch.column("_planes")
            lengths = np.diff(np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset:blobs.offset + len(ids) + 1])
            for size, length in np.unique(np.stack([sizes, lengths], axis=1), axis=0).tolist():
                at = np.flatnonzero((sizes == size) & (lengths == length))
                groups = -(-size // GROUP)
                raw = b"".join(blobs.take(pa.array(at)).to_pylist())
                planes = np.frombuffer(raw, np.uint8).reshape(len(at), length // groups if groups else 1, groups)
                for part, sums in blocks.get(size, ()):
                    for anchor, scores in zip(part, sums.scores(planes)):
                        take(bests, anchor, scores.astype(np.int64), ids[at], labels[at])
        yield bests.table()

    return candidates.mapInArrow(apply, FOUND)


def _positives(bests, anchor, scores, ids, labels):
    same = (labels == anchor["label"]) & (ids != anchor["id"])
    bests.add((anchor["number"], 0), scores[same], ids[same])


def _negatives(low: int, high: int):
    def take(bests, anchor, scores, ids, labels):
        others, names = scores[labels != anchor["label"]], ids[labels != anchor["label"]]
        for wanted in anchor["wanted"]:
            near = (100 * others >= low * wanted) & (100 * others <= high * wanted)
            bests.add((anchor["number"], wanted), others[near], names[near])

    return take


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k)


def mine(table: DataFrame, is_anchor: Column, id_column: str = "vec_id", label_column: str = "label",
         vector_column: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: float = 256.0, batch: int = BATCH) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Anchors are the rows of ``table`` where ``is_anchor`` holds. An anchor's positives are its ``positives`` best other rows of
    the same label; for each, the ``negatives`` best rows of other labels with scores between ``low`` and ``high`` percent of the
    positive's score are returned.
    """
    spark = table.sparkSession
    prepare(spark)
    candidates = keep(packed(usable(table, id_column, label_column, vector_column, scale), scale))
    whole = F.transform("_vector", lambda x: F.floor(x * scale))
    own = usable(table.where(is_anchor), id_column, label_column, vector_column, scale)
    anchors = keep(own.select("_id", "_label", whole.alias("_whole")).distinct().withColumn(
        "_number", F.monotonically_increasing_id()))
    n_batches, out = max(1, -(-anchors.count() // batch)), None
    for number in range(n_batches):
        # consecutive numbers go to different batches, so no id, label or vector can fill one
        part = anchors.where(F.col("_number") % n_batches == number)
        rows = [{"number": r["_number"], "id": r["_id"], "label": r["_label"], "vector": r["_whole"], "wanted": ()}
                for r in part.collect()]
        found = _scored(candidates, spark.sparkContext.broadcast(rows), positives, _positives)
        chosen = keep(_ranked(found, ["anchor"], positives).select(
            "anchor", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
        wanted = {}
        for r in chosen.select("anchor", "positive_score").distinct().collect():
            wanted.setdefault(r["anchor"], []).append(r["positive_score"])
        rows = [{**r, "wanted": wanted[r["number"]]} for r in rows if r["number"] in wanted]
        found = _scored(candidates, spark.sparkContext.broadcast(rows), negatives, _negatives(low, high))
        ranked = _ranked(found, ["anchor", "positive_score"], negatives)
        result = (ranked.join(chosen, ["anchor", "positive_score"])
                  .join(part.select(F.col("_number").alias("anchor"), F.col("_id").alias("anchor_id")), "anchor")
                  .select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score",
                          F.col("score").alias("negative_score")))
        if n_batches > 1:
            result = keep(result)
        out = result if out is None else out.unionByName(result)
    return out.select(*RESULT)
