"""Substring dedup on bytes by a family of suffix arrays whose sizes grow geometrically.

A byte goes when a ``length``-byte string that covers it also starts in a document with a smaller id. Only suffixes that
start at the first window of a run (neighbouring windows with one content-chosen seed, see ``rolling.runs``) enter an array,
so the arrays hold about one entry for 17 bytes. An entry carries the digest of its seed and of the stretch that its run
covers; arrays are ordered by these digests, since any total order serves a merge scan.

1. Every task turns its documents into batches; a batch's array is settled there (of equal stretches the smallest id stays,
   the others are marked), split by seed into buckets and shuffled. However hot a stretch is, a batch ships it once.
2. A bucket's task takes the batches in order of their ids. Each is merge-scanned against every existing level, matches with
   smaller ids are marked, the rest becomes a new level, and equal-sized levels merge.
3. Stretches whose seed also stands in another stretch are matched in part at most. Their windows go through steps 1 and 2
   once more, one entry per window.

Buckets are as many as the session has shuffle partitions: more data, more partitions, equal buckets.

Defined cases: a null or empty text has no bytes; texts shorter than ``length`` never lose any; rows of one id do not remove
from each other; a null id comes after all others; exact repeats of a row give equal rows. Input columns of any name pass
through inside the ``_row`` struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid.llm import rolling, spans
from tallgrid.llm.shared import keep_at, partitions, prepare

ENTRY = np.dtype([("order", "<u8"), ("rest", "<u4"), ("id", "<i8"), ("key", "<i4"), ("start", "<u4"), ("count", "<u4")])
PLACE = ["id", "key", "start", "count"]
FLUSH = 1 << 20  # entries of one batch
BATCH = "bucket int, low long, n int, digests binary, places binary, gone int, gone_places binary"
MARK = "_id long, _key int, partial boolean, _pairs binary"


def equal_neighbours(entries: np.ndarray) -> np.ndarray:
    return (entries["order"][1:] == entries["order"][:-1]) & (entries["rest"][1:] == entries["rest"][:-1])


def arrange(entries: np.ndarray) -> np.ndarray:
    """The order of a suffix array: by digests."""
    by = np.argsort(entries["order"], kind="stable")
    first = entries["order"][by]
    tied = np.flatnonzero(first[1:] == first[:-1])
    if len(tied) and (entries["rest"][by[tied]] != entries["rest"][by[tied + 1]]).any():
        by = np.lexsort((entries["rest"], entries["order"]))
    return by


def settle(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, mask in that order of the entries for which an equal one has a smaller id)."""
    by = arrange(entries)
    if not len(by):
        return by, np.zeros(0, bool)
    ordered = entries[by]
    first = np.flatnonzero(np.append(True, ~equal_neighbours(ordered)))
    least = np.minimum.reduceat(ordered["id"], first)
    return by, ordered["id"] > np.repeat(least, np.diff(np.append(first, len(by))))


class Levels:
    """Suffix arrays of falling size; ``marked`` gathers the entries that an equal one with a smaller id beats."""

    def __init__(self):
        self.levels: list[np.ndarray] = []
        self.marked: list[np.ndarray] = []

    def _settled(self, entries: np.ndarray) -> np.ndarray:
        by, gone = settle(entries)
        self.marked.append(entries[by[gone]])
        return entries[by[~gone]]

    def add(self, batch: np.ndarray) -> None:
        batch = self._settled(batch)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["order"], batch["order"]), len(level) - 1)
            there = level[at]
            beaten = ((there["order"] == batch["order"]) & (there["rest"] == batch["rest"]) & (there["id"] < batch["id"]))
            self.marked.append(batch[beaten])
            batch = batch[~beaten]
        if len(batch):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self._merge()

    def _merge(self) -> None:
        small, large = self.levels.pop(), self.levels.pop()
        self.levels.append(self._settled(np.concatenate([large, small])))

    def close(self) -> np.ndarray:
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else np.zeros(0, ENTRY)


def several_kinds(array: np.ndarray) -> np.ndarray:
    """Entries of a closed array whose seed digest also begins another, different entry."""
    if not len(array):
        return array
    seed = array["order"] >> np.uint64(32)
    kind = np.append(True, ~equal_neighbours(array))
    first = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
    kinds = np.add.reduceat(kind.astype(np.int64), first)
    return array[np.repeat(kinds > 1, np.diff(np.append(first, len(array))))]


def _shrink(entries: np.ndarray) -> bytes:
    body = b"".join([np.diff(entries["id"], prepend=0).tobytes(), *(entries[c].tobytes() for c in PLACE[1:])])
    return pa.compress(body, codec="zstd", asbytes=True)


def _grow(n: int, body: bytes, digests: bytes | None = None) -> np.ndarray:
    out = np.zeros(n, ENTRY)
    raw, at = pa.decompress(body, n * 20, codec="zstd", asbytes=True), 0
    for name in PLACE:
        width = ENTRY[name].itemsize
        out[name] = np.frombuffer(raw, ENTRY[name], n, at)
        at += n * width
    out["id"] = np.cumsum(out["id"])
    if digests is not None:
        out["order"] = np.frombuffer(digests, "<u8", n)
        out["rest"] = np.frombuffer(digests, "<u4", n, 8 * n)
    return out


def _batch_rows(buckets: np.ndarray, entries: np.ndarray, seed: int, n_buckets: int) -> pa.RecordBatch:
    """One row per bucket: the settled entries, in document order, and beaten ones, dealt out evenly."""
    by, gone = settle(entries)
    beaten = np.zeros(len(entries), bool)
    beaten[by[gone]] = True
    lost, buckets, entries = entries[beaten], buckets[~beaten], entries[~beaten]
    order = np.argsort(buckets, kind="stable")
    cuts = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    shares = np.linspace(0, len(lost), n_buckets + 1).astype(np.int64)
    columns = {name: [] for name in ("bucket", "low", "n", "digests", "places", "gone", "gone_places")}
    for b in range(n_buckets):
        own, away = entries[order[cuts[b]:cuts[b + 1]]], (b + seed) % n_buckets
        beaten_here = lost[shares[away]:shares[away + 1]]
        if not len(own) and not len(beaten_here):
            continue
        for name, value in zip(columns, (b, int(own["id"].min()) if len(own) else 0, len(own),
                                         own["order"].tobytes() + own["rest"].tobytes(), _shrink(own),
                                         len(beaten_here), _shrink(beaten_here))):
            columns[name].append(value)
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds)], list(columns))


def _entries(ids, keys, document, start, count, order, rest) -> np.ndarray:
    out = np.empty(len(document), ENTRY)
    out["id"], out["key"] = ids[document], keys[document]
    out["start"], out["count"], out["order"], out["rest"] = start, count, order, rest
    return out


def suffix_batches(documents: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Arrays of batches, a row per bucket. With a column ``_pairs``, of the windows of these runs; else of all runs."""
    by_window = "_pairs" in documents.columns

    def of_runs(ids, keys, row, symbols, found):
        document, start, count, seed, run = rolling.runs(symbols.prefix, symbols.bounds, length)
        order = seed >> np.uint64(32) << np.uint64(32) | run >> np.uint64(32)
        return (seed % np.uint64(n_buckets)).astype(np.int64), _entries(
            ids, keys, row + document, start - symbols.bounds[document], count, order, run.astype(np.uint32))

    def of_windows(ids, keys, row, symbols, found):
        hashes = symbols.prefix.windows(length)
        document, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(symbols.bounds) - 1):
            at = np.frombuffer(b"".join(found[row + i].as_py()), spans.PAIR)
            counts = at["count"].astype(np.int64)
            first = np.repeat(at["start"].astype(np.int64), counts)
            places.append(first + np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts))
            document.append(np.full(len(first), i))
        document, places = np.concatenate(document), np.concatenate(places)
        digest = hashes[symbols.bounds[document] + places]
        return (digest % np.uint64(n_buckets)).astype(np.int64), _entries(
            ids, keys, row + document, places, 1, digest, digest.astype(np.uint32))

    def apply(batches):
        held, size, seed = [], 0, 0

        def flush():
            return _batch_rows(np.concatenate([b for b, _ in held]), np.concatenate([e for _, e in held]), seed, n_buckets)

        for batch in batches:
            ids, keys = batch.column("_id").to_numpy(), batch.column("_key").to_numpy()
            found = batch.column("_pairs") if by_window else None
            for row, data, bounds in rolling.slices(batch.column("_text")):
                part = (of_windows if by_window else of_runs)(ids, keys, row, spans.Symbols(data, bounds, False), found)
                held.append(part)
                size += len(part[1])
                if size >= FLUSH:
                    yield flush()
                    held, size, seed = [], 0, seed + 1
        if size:
            yield flush()

    columns = ["_id", "_key", "_text", *(["_pairs"] if by_window else [])]
    return documents.select(*columns).mapInArrow(apply, BATCH)


def _marks(entries: np.ndarray, partial: bool) -> pa.Table:
    entries = entries[np.lexsort((entries["start"], entries["key"], entries["id"]))]
    new = np.append(True, (entries["id"][1:] != entries["id"][:-1]) | (entries["key"][1:] != entries["key"][:-1]))
    first = np.flatnonzero(new) if len(entries) else np.zeros(0, np.int64)
    packed = spans.pairs(entries["start"], entries["count"])
    return pa.table([pa.array(entries["id"][first]), pa.array(entries["key"][first]),
                     pa.array(np.full(len(first), partial)),
                     pa.array(spans.blobs(packed, np.append(first, len(entries))), pa.binary())],
                    ["_id", "_key", "partial", "_pairs"])


def match_levels(batches: DataFrame, windows: bool) -> DataFrame:
    """Merge-scan the batches of each bucket: marked stretches, and (``partial``) those to look at window by window."""
    def apply(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["low"])
        family, lost = Levels(), []
        for r in rows:
            lost.append(_grow(r["gone"], r["gone_places"]))
            if r["n"]:
                family.add(_grow(r["n"], r["places"], r["digests"]))
        array = family.close()
        marked = _marks(np.concatenate([*lost, *family.marked]), False)
        return marked if windows else pa.concat_tables([marked, _marks(several_kinds(array), True)])

    return batches.groupBy("bucket").applyInArrow(apply, MARK)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 50,
                   characters: bool = False) -> DataFrame:
    """``_row`` (the input row), ``kept`` (binary), ``n_symbols`` (bytes), ``n_removed`` and ``n_spans``.

    With ``characters`` a character goes as a whole if one of its bytes does."""
    spark = docs.sparkSession
    prepare(spark)
    n_buckets = partitions(spark)
    documents = spans.keyed(docs, id_column, text_column)
    first, _ = keep_at(match_levels(suffix_batches(documents, length, n_buckets), False))
    partial = first.where("partial").groupBy("_id", "_key").agg(F.collect_list("_pairs").alias("_pairs"))
    opened = documents.drop("_row").join(partial.hint("shuffle_hash"), ["_id", "_key"])
    second, _ = keep_at(match_levels(suffix_batches(opened, length, n_buckets), True))
    marks = first.where("not partial").unionByName(second).select("_id", "_key", "_pairs")
    return spans.cut_out(documents, marks, length, False, text_column, characters)
