"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. Every stretch of ``tile`` words of a benchmark item is a seed; hashes of the
same stretches of a document, by running sums, find the seeds it shares. Neighbouring shared seeds on one diagonal form
maximal matches; the longest match is marked first, and what other matches have left beside marked words stays in play, until
no match of ``tile`` words is left. No word is marked twice, in the item or in the document, so moved passages count and
repeated ones do not count again. A document leaks an item when its tiles cover at least ``coverage`` of the item's words.

The benchmark goes to the tasks in blocks of about ``BLOCK_WORDS`` words, one scan of the documents for each: what is
broadcast has that bound, and any number of items works. Nothing is shuffled.

Defined cases: null or wordless texts leak nothing; items with fewer than ``tile`` words cannot be found; equal items are
reported each; repeated document rows are reported each; an empty benchmark leaks nothing.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid.llm import rolling, spans

BLOCK_WORDS = 1 << 21
LEAK = "_id long, _key int, item_id long, n_words long, n_covered long, n_tiles long, coverage double"


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, values, limits = rolling.words(rolling.LOWER[data], bounds, rolling.PUNCTUATION)
    return values, limits


class Seeds:
    """The seeds of one block of items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], tile: int):
        data = np.frombuffer("".join(t for _, t in items).encode(), np.uint8)
        values, limits = _words(data, np.cumsum([0] + [len(t.encode()) for _, t in items]))
        hashes = rolling.Prefix(values).windows(tile)
        self.names, self.sizes = np.array([i for i, _ in items], np.int64), np.diff(limits)
        item = np.repeat(np.arange(len(items)), self.sizes)[:len(hashes)]
        place = np.arange(len(hashes)) - limits[item]
        inside = place + tile <= self.sizes[item]
        order = np.argsort(hashes[inside], kind="stable")
        self.hashes, self.item, self.place = hashes[inside][order], item[inside][order], place[inside][order]
        self.rough = np.zeros(1 << 20, bool)
        self.rough[(self.hashes >> np.uint64(44)).astype(np.int64)] = True


def tiles(item_at: np.ndarray, doc_at: np.ndarray, tile: int, size: int) -> tuple[int, int]:
    """(words covered, tiles) of an item of ``size`` words, from the shared seeds at these places."""
    order = np.lexsort((item_at, doc_at - item_at))
    a, d = item_at[order], doc_at[order]
    new = np.append(True, (np.diff(d - a) != 0) | (np.diff(a) != 1))
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(a))) + tile - 1
    heap = [(-n, x, y) for n, x, y in zip(lengths.tolist(), a[first].tolist(), d[first].tolist())]
    heapq.heapify(heap)
    in_item, in_doc, count = np.zeros(size, bool), set(), 0
    while heap:
        n, x, y = heapq.heappop(heap)
        free = [not in_item[x + k] and y + k not in in_doc for k in range(-n)]
        if all(free):
            in_item[x:x - n] = True
            in_doc.update(range(y, y - n))
            count += 1
            if in_item.all():
                break
            continue
        k = 0
        while k < -n:
            if not free[k]:
                k += 1
                continue
            end = k
            while end < -n and free[end]:
                end += 1
            if end - k >= tile:
                heapq.heappush(heap, (k - end, x + k, y + k))
            k = end
    return int(in_item.sum()), count


def found(seeds: Seeds, data: np.ndarray, bounds: np.ndarray, tile: int, coverage: float):
    """(document, item, words covered, tiles) of the leaks in one slice."""
    values, limits = _words(data, bounds)
    hashes = rolling.Prefix(values).windows(tile)
    at = np.flatnonzero(seeds.rough[(hashes >> np.uint64(44)).astype(np.int64)])
    low, high = np.searchsorted(seeds.hashes, hashes[at], "left"), np.searchsorted(seeds.hashes, hashes[at], "right")
    document = np.searchsorted(limits, at, "right") - 1
    good = (high > low) & (at + tile <= limits[document + 1])
    at, low, n, document = at[good], low[good], (high - low)[good], document[good]
    which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    at, document = np.repeat(at, n), np.repeat(document, n)
    item, place = seeds.item[which], seeds.place[which]
    order = np.lexsort((place, item, document))
    at, document, item, place = at[order], document[order], item[order], place[order]
    if not len(at):
        return
    first = np.flatnonzero(np.append(True, (np.diff(document) != 0) | (np.diff(item) != 0)))
    for a, b in zip(first.tolist(), np.append(first[1:], len(at)).tolist()):
        size = int(seeds.sizes[item[a]])
        spots = np.unique(place[a:b])
        most = int(rolling.covered(size, spots, spots + tile).sum())  # no tiling covers more
        if most >= coverage * size:
            words, count = tiles(place[a:b], at[a:b], tile, size)
            if words >= coverage * size:
                yield int(document[a]), int(item[a]), words, count


def blocks(spark, benchmark: DataFrame, item_column: str, text_column: str, tile: int):
    """Broadcast seeds of the benchmark, block after block."""
    items = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(text_column).cast("string").alias("text"))
    items = items.where("item is not null and text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-int(words) // BLOCK_WORDS)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").collect()
        yield spark.sparkContext.broadcast(Seeds([(r[0], r[1]) for r in rows], tile))


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          item_column: str = "item_id", item_text: str = "text", tile: int = 5, coverage: float = 0.6) -> DataFrame:
    """One row per document and item that it leaks."""
    spark = docs.sparkSession
    documents = spans.keyed(docs, id_column, text_column).select("_id", "_key", "_text")
    out = None
    for seeds in blocks(spark, benchmark, item_column, item_text, tile):
        def apply(batches, seeds=seeds):
            for batch in batches:
                rows, ids, keys = [], batch.column("_id").to_numpy(), batch.column("_key").to_numpy()
                for row, data, bounds in rolling.slices(batch.column("_text")):
                    for d, i, words, count in found(seeds.value, data, bounds, tile, coverage):
                        size = int(seeds.value.sizes[i])
                        rows.append((ids[row + d], keys[row + d], seeds.value.names[i], size, words, count, words / size))
                if rows:
                    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                     ["_id", "_key", "item_id", "n_words", "n_covered", "n_tiles", "coverage"])

        part = documents.mapInArrow(apply, LEAK)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], LEAK) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
                  item_text: str = "text", tile: int = 5, coverage: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that leak no item, columns unchanged; a row never leaves its task."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"))
    for seeds in blocks(spark, benchmark, item_column, item_text, tile):
        def apply(batches, seeds=seeds):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, data, bounds in rolling.slices(batch.column("_text")):
                    for d, *_ in found(seeds.value, data, bounds, tile, coverage):
                        clean[row + d] = False
                yield batch.filter(pa.array(clean))

        rows = rows.mapInArrow(apply, rows.schema)
    return rows.select("_row.*")
