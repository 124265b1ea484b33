"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

A window is ``length`` consecutive words of one document. A word goes when a window that covers it starts with the same
words in a document with a smaller id. Windows are hashed by rolling sums and counted in two steps, so that copies do not
multiply rows: neighbouring windows that share a seed are counted as one run; only runs whose seed also stands in another
run are counted window by window. Both counts are plain aggregations (smallest id per hash, combined before the shuffle),
so a passage that a third of the corpus repeats costs each task one row per run.

Defined cases: a null or blank text has no words and stays empty; fewer words than ``length`` are never removed; rows of
the same id never remove words from each other; a null id comes after all others; exact repeats of a row give equal rows.
Input columns of any name pass through inside the ``_row`` struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid.llm import rolling, spans
from tallgrid.llm.shared import keep, prepare

RUN = "_id long, _key int, start long, count long, seed long, run long"
WINDOW = "_id long, _key int, start long, hash long"


def word_runs(documents: DataFrame, length: int) -> DataFrame:
    """The runs of windows of each document: seed hash, run hash, first window, number of windows."""
    def apply(batches):
        for batch in batches:
            ids, keys = batch.column("_id").to_numpy(), batch.column("_key").to_numpy()
            for row, data, bounds in rolling.slices(batch.column("_text")):
                symbols = spans.Symbols(data, bounds, True)
                document, start, count, seed, run = rolling.runs(symbols.prefix, symbols.bounds, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row + document]), pa.array(keys[row + document]),
                     pa.array(start - symbols.bounds[document]), pa.array(count),
                     pa.array(seed.view(np.int64)), pa.array(run.view(np.int64))],
                    ["_id", "_key", "start", "count", "seed", "run"])

    return documents.select("_id", "_key", "_text").mapInArrow(apply, RUN)


def run_windows(open_runs: DataFrame, length: int) -> DataFrame:
    """One row per window of the runs in ``_pairs``, with its Rabin-Karp hash."""
    def apply(batches):
        for batch in batches:
            ids, keys, found = batch.column("_id").to_numpy(), batch.column("_key").to_numpy(), batch.column("_pairs")
            for row, data, bounds in rolling.slices(batch.column("_text")):
                symbols = spans.Symbols(data, bounds, True)
                hashes = symbols.prefix.windows(length)
                document, places = [], []
                for i in range(len(bounds) - 1):
                    at = np.frombuffer(found[row + i].as_py(), spans.PAIR)
                    counts = at["count"].astype(np.int64)
                    first = np.repeat(at["start"].astype(np.int64), counts)
                    inner = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
                    places.append(first + inner)
                    document.append(np.full(len(first), i))
                document, places = np.concatenate(document), np.concatenate(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row + document]), pa.array(keys[row + document]), pa.array(places),
                     pa.array(hashes[symbols.bounds[document] + places].view(np.int64))],
                    ["_id", "_key", "start", "hash"])

    return open_runs.select("_id", "_key", "_text", "_pairs").mapInArrow(apply, WINDOW)


def packed(df: DataFrame) -> DataFrame:
    """(first window, number of windows) rows as one binary ``_pairs`` per document."""
    pair = F.concat(*[F.lpad(F.hex(c), 8, "0") for c in ("start", "count")])
    return df.groupBy("_id", "_key").agg(F.array_join(F.collect_list(pair), "").alias("_hex")).select(
        "_id", "_key", F.unhex("_hex").alias("_pairs"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 50) -> DataFrame:
    """``_row`` (the input row), ``kept`` (binary, remaining words joined by one blank), ``n_symbols`` (words),
    ``n_removed`` and ``n_spans`` (maximal removed intervals)."""
    spark = docs.sparkSession
    prepare(spark)
    documents = spans.keyed(docs, id_column, text_column)
    runs = keep(word_runs(documents, length))
    first = keep(runs.groupBy("seed", "run").agg(F.min("_id").alias("first_id"), F.count("*").alias("n")))
    shared = keep(first.groupBy("seed").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("n > 1")
                  .select("seed", "kinds"))
    # runs that stand alone in the corpus leave here; both sides are tables, so a hot seed's rows can be split
    rows = keep(keep(runs.join(shared, "seed")).join(first.select("seed", "run", "first_id"), ["seed", "run"]))
    whole = rows.where("_id > first_id").select("_id", "_key", "start", "count")
    parts = packed(rows.where("_id = first_id and kinds > 1").select("_id", "_key", "start", "count"))
    opened = documents.select("_id", "_key", "_text").join(parts.hint("shuffle_hash"), ["_id", "_key"])
    windows = keep(run_windows(opened, length))
    least = keep(windows.groupBy("hash").agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))
                 .where("first_id < last_id").select("hash", "first_id"))
    single = (windows.join(least, "hash").where("_id > first_id")
              .select("_id", "_key", "start", F.lit(1).cast("long").alias("count")))
    marks = packed(whole.unionByName(single))
    return spans.cut_out(documents, marks, length, True, text_column)
