"""Best-fit packing of token sequences by large-item matching.

A document's ids are counted in tasks and cut into pieces of at most ``capacity`` (the first piece may be shorter). Lengths
above a third of the capacity can only stand two to a sequence: the longest is matched with the longest that still fits, which
is optimal for them. The others are placed longest first into the smallest gap that holds them. All of this is decided on the
number of pieces of each length, at most ``capacity`` numbers, and comes back as placement runs: so many pieces of one length
go to so many consecutive sequences. Pieces learn their place by their rank among those of equal length; ranks are counted
inside hashed parts of a length, so a length that a third of all pieces share is no single group.

Defined cases: a null text is empty and yields one piece, the end id; repeated rows are packed as separate pieces; an empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrid.llm import spans, tokens
from tallgrid.llm.shared import keep, partitions, prepare

PIECE = "_id long, _key int, piece int, start long, length long, ids_crc32 long"
RUN = "length long, low long, high long, first_sequence long, per_sequence long, first_offset long"


def pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """The pieces of ``spans.keyed`` documents with the crc32 of their ids as little-endian 32-bit integers."""
    def apply(batches):
        for batch in batches:
            own, keys = batch.column("_id").to_numpy(), batch.column("_key").to_numpy()
            for row, ids, bounds in tokens.encoded(batch.column("_text"), tokenizer, end_id):
                wide, out = ids.astype("<u4"), []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), row):
                    cuts = [0, *range((b - a - 1) % capacity + 1, b - a + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                        out.append((own[i], keys[i], k, x, y - x, zlib.crc32(wide[a + x:a + y])))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    ["_id", "_key", "piece", "start", "length", "ids_crc32"])

    return documents.select("_id", "_key", "_text").mapInArrow(apply, PIECE)


def placements(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Placement runs for so many pieces of each length.

    A run (length, low, high, first sequence, per sequence, first offset) places the pieces ranked low to high - 1 among those
    of their length, ``per sequence`` of them one behind the other in each of consecutive sequences.
    """
    left = {size: n for size, n in counts.items() if n > 0}
    ranks: dict[int, int] = {}
    runs: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the gaps that exist, ascending
    used = 0

    def place(size, sequence, n, each, gap):
        low = ranks.get(size, 0)
        ranks[size] = low + n * each
        runs.append((size, low, low + n * each, sequence, each, capacity - gap))

    def leave(gap, sequence, n):
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((sequence, n))

    large = sorted(size for size in left if 3 * size > capacity)
    while large:
        size = large[-1]
        at = bisect.bisect_right(large, capacity - size) - 1
        partner = large[at] if at >= 0 else None
        if partner == size and left[size] == 1:
            partner = large[at - 1] if at > 0 else None
        n = left[size] if partner is None else left[size] // 2 if partner == size else min(left[size], left[partner])
        place(size, used, n, 1, capacity)
        left[size] -= n
        if partner is not None:
            place(partner, used, n, 1, capacity - size)
            left[partner] -= n
        leave(capacity - size - (partner or 0), used, n)
        used += n
        large = [x for x in large if left[x]] if not left[size] or not left.get(partner, 1) else large
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                n = -(-left[size] // (capacity // size))
                leave(capacity, used, n)
                used += n
                continue
            gap = order[at]
            sequence, n = gaps[gap].pop()
            each = gap // size
            full = min(n, left[size] // each)
            if full:
                place(size, sequence, full, each, gap)
                left[size] -= full * each
                leave(gap - each * size, sequence, full)
            if full < n and 0 < left[size] < each:
                rest = left[size]
                place(size, sequence + full, 1, rest, gap)
                left[size] = 0
                leave(gap - rest * size, sequence + full, 1)
                full += 1
            leave(gap, sequence + full, n - full)
            if not gaps[gap]:
                del gaps[gap]
                order.remove(gap)
    return runs


def pack(items: DataFrame, capacity: int, by: list[str]) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``) plus ``sequence_id`` and ``offset``; ``by`` orders equal lengths."""
    spark = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(placements(counts, capacity), RUN)
    part = F.pmod(F.xxhash64(*by), F.lit(partitions(spark)))
    parted = items.withColumn("_part", part)
    sizes = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*by)) - 1
    ranked = (parted.withColumn("_inner", inner).join(bases, ["length", "_part"])
              .withColumn("_rank", F.col("_base") + F.col("_inner")))
    # the runs do not grow with the data: their number depends on the capacity alone
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("_rank") >= F.col("low"))
                         & (F.col("_rank") < F.col("high"))).drop(runs["length"])
    turn = F.col("_rank") - F.col("low")
    return placed.select(
        *items.columns, (F.col("first_sequence") + F.floor(turn / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("first_offset") + turn % F.col("per_sequence") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
                   capacity: int = 2048) -> DataFrame:
    """Every piece of every document (``_id``, ``_key``, ``piece``, ``start``, ``length``, ``ids_crc32``) with its place."""
    prepare(docs.sparkSession)
    cut = keep(pieces(spans.keyed(docs, id_column, text_column), tokenizer, capacity))
    return pack(cut, capacity, ["_id", "_key", "piece"])
