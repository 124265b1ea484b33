"""Periodic runs of words: scale-tiled search with boundary Z-functions.

A run is a stretch of consecutive words with smallest period q, of length at least ``LEAST`` and ``TIMES`` q, that no neighbouring
word extends. Periods are taken by scale: scale 0 has the periods below ``BASE``, each further scale the next octave. For
every scale that a document is long enough for, the document is cut into tiles of 16 times the scale's largest period that
overlap by twice that period, so that what a tile sees of a run, if it is less than two periods, a neighbour sees too.

Tiles are solved alone. For the periods [B, 2B) of one octave, boundaries stand at every B words: a run of two periods or more
contains a boundary b with its whole next period. The Z-function at b gives how far the words from b agree with those from
b + q, the reversed one how far those before b do; one period in sum is a periodic fragment. All (b, q) of an octave, as many
as there are words, are probed at once; agreement is that of hashes. A fragment with a period that divides q is
dropped. One that ends inside its tile and is too short for a run is, too; the others are shuffled by document and period
and stitched where they overlap by a period or more.

Tiles of ordinary documents are solved in the task that reads the text; those of texts over ``LONG`` bytes are dealt over all
tasks. What is gathered in one group is the fragments of one document and period, or the runs of one document.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows have equal results, rows of one id with
different texts are told apart, null ids are allowed. Input columns of any name pass through inside the ``_row`` struct.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrid.llm import rolling, spans
from tallgrid.llm.shared import keep, partitions, prepare

TIMES, LEAST, BASE, LONG = 4, 6, 256, 1 << 22
PRIME, BASES = 2**31 - 1, (1_204_787_563, 1_799_382_211)
TILE = "_id long, _key int, scale int, start long, size long, words binary"
FRAGMENT = "_id long, _key int, period long, start long, end long"


def limits(scale: int) -> tuple[int, int]:
    """The periods [low, high) of a scale."""
    return (BASE << (scale - 1), BASE << scale) if scale else (1, BASE)


def tile_starts(size: int, scale: int) -> np.ndarray:
    """First words of the tiles of 16 high words that cover a document, overlapping by 2 high."""
    high = limits(scale)[1]
    return np.arange(0, max(1, size - 2 * high), 14 * high)


def tiles(batches):
    """From batches of documents, one row per document, scale and tile with the hashes of its words; ``size`` is the document's
    number of words."""
    for batch in batches:
        ids, keys = batch.column("_id").to_pylist(), batch.column("_key").to_pylist()
        for row, data, bounds in rolling.slices(batch.column("_text")):
            _, _, values, cuts = rolling.words(data, bounds)
            rows = []
            for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                scale, size = 0, z - a
                while size >= max(LEAST, TIMES * limits(scale)[0]):
                    length = 16 * limits(scale)[1]
                    rows += [(ids[row + i], keys[row + i], scale, s, size, values[a + s:min(z, a + s + length)].tobytes())
                             for s in tile_starts(size, scale).tolist()]
                    scale += 1
            yield _batch(rows, TILE)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields])


@lru_cache(maxsize=64)
def _powers(base: int, bits: int) -> np.ndarray:
    """The first 2 ** bits powers of ``base`` modulo ``PRIME``."""
    out = np.ones(1, np.int64)
    while len(out) < 1 << bits:
        out = np.append(out, out * pow(base, len(out), PRIME) % PRIME)
    return out


class Prefix:
    """Hashes of any range of words: two polynomials modulo a prime. (Modulo a power of two, some sequences of two words that
    differ have equal hashes whatever the base.)"""

    def __init__(self, words: np.ndarray):
        self.bits, self.sums = len(words).bit_length(), []
        for base, shift in zip(BASES, (0, 32)):
            values = (words >> np.uint64(shift)).astype(np.int64) % PRIME
            values *= _powers(base, self.bits)[:len(words)]
            self.sums.append(np.append(0, np.cumsum(values % PRIME)))

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = ((s[end] - s[start]) % PRIME * _powers(pow(base, -1, PRIME), self.bits)[start] % PRIME
                    for s, base in zip(self.sums, BASES))
        return one << 31 | two


@lru_cache(maxsize=1 << 16)
def _prime_factors(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return tuple(out + [n] if n > 1 else out)


def _agreement(prefix: Prefix, left: np.ndarray, right: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many symbols from ``left`` on equal those from ``right`` on (``step`` 1), or up to them (-1), at most ``most``."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        back = mid if step < 0 else 0
        same = prefix.ranges(left - back, left - back + mid) == prefix.ranges(right - back, right - back + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def fragments(words: np.ndarray, bounds: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(tile, start, end, period) of all stretches inside the tiles with smallest period in [low, high), two periods or longer.

    ``words`` are the tiles' word hashes one after the other, ``bounds`` their limits; places are counted in each tile.
    """
    prefix, found = Prefix(words), []
    sizes = np.diff(bounds)
    tile = np.repeat(np.arange(len(sizes)), sizes)
    first, last = bounds[tile], bounds[tile + 1]
    inside = np.arange(len(words)) - first
    step = low
    while step < high:
        # place r of a tile stands for boundary r - r % step and period step + r % step
        extra = inside % step
        other = np.arange(len(words)) + step
        at = np.flatnonzero(other < last)
        left = at - extra[at]
        near = words[left] == words[other[at]]
        near |= (inside[left] > 0) & (words[left - 1] == words[other[at] - 1])
        at, left = at[near], left[near]
        right, period = at + step, step + extra[at]
        # one side must agree for half a period
        half, ahead, behind = (period + 1) // 2, last[at] - right, left - first[at]
        near = np.zeros(len(at), bool)
        fits = np.flatnonzero(ahead >= half)
        near[fits] = prefix.ranges(left[fits], left[fits] + half[fits]) == prefix.ranges(right[fits], right[fits] + half[fits])
        fits = np.flatnonzero(~near & (behind >= half))
        near[fits] = prefix.ranges(left[fits] - half[fits], left[fits]) == prefix.ranges(right[fits] - half[fits], right[fits])
        at, left, right, period, ahead, behind = (x[near] for x in (at, left, right, period, ahead, behind))
        forward, backward = _agreement(prefix, left, right, ahead, 1), _agreement(prefix, left, right, behind, -1)
        near = forward + backward >= period
        found.append(np.stack([tile[at], left - backward, right + forward, period], axis=1)[near])
        step *= 2
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
    whole = np.ones(len(rows), bool)
    tested = [(i, q // p) for i, q in enumerate(rows[:, 3].tolist()) for p in _prime_factors(q)]
    if tested:
        i, shorter = np.array(tested).T
        start, end = rows[i, 1], rows[i, 2]
        whole[i[prefix.ranges(start, end - shorter) == prefix.ranges(start + shorter, end)]] = False
    rows = rows[whole]
    begin = bounds[rows[:, 0]]
    return rows[:, 0], rows[:, 1] - begin, rows[:, 2] - begin, rows[:, 3]


def solve(batches, limit: int = 1 << 20):
    """From batches of tiles, the fragments of each tile that may belong to a run; about ``limit`` words at a time."""
    for batch in batches:
        scales, lengths = batch.column("scale").to_numpy(), pc.binary_length(batch.column("words")).to_numpy() // 8
        for scale in np.unique(scales).tolist():
            own = np.flatnonzero(scales == scale)
            groups = np.cumsum(lengths[own], dtype=np.int64) // limit
            for group in np.unique(groups):
                yield _solved(batch, own[groups == group], scale)


def _solved(batch: pa.RecordBatch, at: np.ndarray, scale: int) -> pa.RecordBatch:
    part = batch.take(pa.array(at))
    blobs = part.column("words").to_pylist()
    bounds = np.append(0, np.cumsum([len(b) // 8 for b in blobs])).astype(np.int64)
    tile, start, end, period = fragments(np.frombuffer(b"".join(blobs), np.uint64), bounds, *limits(scale))
    origin, size = part.column("start").to_numpy(), part.column("size").to_numpy()
    # a fragment that its tile cuts off may go on in the next tile
    cut = ((start == 0) & (origin[tile] > 0)) | ((end == np.diff(bounds)[tile]) & (origin[tile] + end < size[tile]))
    stay = cut | (end - start >= np.maximum(LEAST, TIMES * period))
    tile, start, end, period = tile[stay], start[stay] + origin[tile[stay]], end[stay] + origin[tile[stay]], period[stay]
    ids = part.column("_id").take(pa.array(tile)), part.column("_key").take(pa.array(tile))
    return pa.RecordBatch.from_arrays([*ids, *map(pa.array, (period, start, end))], ["_id", "_key", "period", "start", "end"])


def stitched(pieces: DataFrame) -> DataFrame:
    """``_id``, ``_key``, ``start``, ``length`` and ``period`` of the runs that the fragments make up."""
    own = Window.partitionBy("_id", "_key", "period").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > reached - F.col("period")).cast("int"), F.lit(1))
    joined = pieces.distinct().withColumn("_opens", opens).withColumn(
        "_island", F.sum("_opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.max("end") - F.min("start")
    runs = joined.groupBy("_id", "_key", "period", "_island").agg(F.min("start").alias("start"), length.alias("length"))
    return runs.where((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period"))).select(
        "_id", "_key", "start", "length", "period")


def find_runs(documents: DataFrame) -> DataFrame:
    """The runs of ``keyed`` documents, one row per run."""
    long, texts = F.octet_length("_text") > LONG, documents.select("_id", "_key", "_text")
    alone = texts.where(~long).mapInArrow(lambda batches: solve(tiles(batches)), FRAGMENT)
    spread = texts.where(long).mapInArrow(tiles, TILE).repartition(partitions(documents.sparkSession))
    return stitched(keep(alone.unionByName(spread.mapInArrow(solve, FRAGMENT))))


def collapse(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``_row`` (the input row), ``n_words``, ``runs`` (start, length, period by start, then period) and ``kept`` (binary).

    ``kept`` has the remaining words, joined by one blank: a word goes if any run contains it after that run's first period.
    """
    prepare(docs.sparkSession)
    documents = spans.keyed(docs, id_column, text_column)
    run = F.struct("start", "length", "period")
    per_row = find_runs(documents).groupBy("_id", "_key").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    # the text travels once, inside its row
    joined = documents.select("_id", "_key", "_row").join(per_row.hint("shuffle_hash"), ["_id", "_key"], "left").select(
        "_row", F.coalesce(F.col(f"_row.`{text_column}`").cast("string"), F.lit("")).alias("_text"), "runs")
    schema = joined.select("_row").schema.add("n_words", "long").add("runs", per_row.schema["runs"].dataType).add("kept", "binary")

    def apply(batches):
        for batch in batches:
            column, sizes, kept = batch.column("runs"), [], []
            for row, data, bounds in rolling.slices(batch.column("_text")):
                starts, ends, _, cuts = rolling.words(data, bounds)
                text = data.tobytes()
                for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    found, own = column[row + i].as_py() or [], slice(a, z)
                    s, e = starts[own], ends[own]
                    if found:
                        first = np.array([r["start"] + r["period"] for r in found])
                        gone = rolling.covered(z - a, first, np.array([r["start"] + r["length"] for r in found]))
                        s, e = s[~gone], e[~gone]
                    sizes.append(z - a)
                    kept.append(b" ".join([text[x:y] for x, y in zip(s.tolist(), e.tolist())]))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(sizes, pa.int64()), column, pa.array(kept, pa.binary())],
                                             ["_row", "n_words", "runs", "kept"])

    out = joined.mapInArrow(apply, schema)
    return out.withColumn("runs", F.coalesce("runs", F.array().cast(per_row.schema["runs"].dataType)))
