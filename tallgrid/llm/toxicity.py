"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Words are lower-cased runs of letters and digits. A text's features are the distinct hashes, of ``BITS`` bits, of its words,
of neighbouring words and of words with one between them. Every coordinate has its own learning rate, and the L1 term keeps
coordinates at exactly zero that few texts speak for; what is left is a small array of weights that goes to all tasks
(2 ** BITS numbers, whatever the input).

Training uses a sample of at most about ``SAMPLE`` labelled rows (chosen by the hash of the id, so the same rows at any
partitioning). Tasks of about ``SHARD_ROWS`` rows each run over their part of it from common states, the states' changes are
averaged in Spark, and ``ROUNDS`` such rounds are made. Scoring is one pass without a shuffle.

Defined cases: a null or wordless text gets the score of the bias alone; rows without label teach nothing, an id with several
labels counts as toxic if any label says so; without any labelled row every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid.llm import rolling
from tallgrid.llm.shared import in_training, keep, prepare

BITS, SAMPLE, SHARD_ROWS, ROUNDS = 18, 48_000, 8_000, 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
THRESHOLD = 0.3
SIZE = 1 << BITS  # the bias is one coordinate more


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of all features of a slice, repeated ones included."""
    _, _, words, limits = rolling.words(rolling.LOWER[data], bounds, rolling.PUNCTUATION)
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(limits))
    found, owners = [words], [document]
    for gap, a, b in ((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        if len(words) > gap:
            same = document[gap:] == document[:-gap]
            found.append(rolling.mix(words[:-gap] * np.uint64(a) + words[gap:] * np.uint64(b))[same])
            owners.append(document[gap:][same])
    return np.concatenate(owners), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def weights_of(z: np.ndarray, n: np.ndarray, l1: float | np.ndarray = L1) -> np.ndarray:
    w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= l1, 0.0, w)


def pass_over(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, int]]) -> None:
    """One FTRL pass over (coordinates, label) rows; changes the states in place."""
    l1 = np.full(SIZE + 1, L1)
    l1[SIZE] = 0.0
    for at, label in rows:
        w = weights_of(z[at], n[at], l1[at])
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        old = n[at]
        z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
        n[at] = old + g * g


def _shard_pass(state):
    """One pass over a shard's rows, in an order that its ids fix, from the broadcast states."""
    def run(table: pa.Table) -> pa.Table:
        old_z, old_n = state.value
        z, n = old_z.copy(), old_n.copy()
        order = np.argsort(rolling.mix(table.column("_id").to_numpy().astype(np.uint64) + np.uint64(1)), kind="stable")
        at, label = table.column("_at").to_pylist(), table.column("_label").to_pylist()
        pass_over(z, n, [(np.append(np.frombuffer(at[k], "<u4").astype(np.int64), SIZE), label[k])
                         for k in order.tolist()])
        moved = np.flatnonzero((n != old_n) | (z != old_z))
        return pa.table({"at": moved, "dz": (z - old_z)[moved], "dn": (n - old_n)[moved]})

    return run


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "toxic") -> np.ndarray | None:
    """The weights, bias last; None without labelled rows."""
    spark = docs.sparkSession
    prepare(spark)
    known = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & in_training(id_column))
             .groupBy(F.col(id_column).cast("long").alias("_id")).agg(F.max(F.col(label_column).cast("int")).alias("_label")))
    total = known.count()
    if not total:
        return None
    spread = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    sample = known.where(spread < int(min(1.0, SAMPLE / total) * (1 << 30)))
    own = docs.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(F.col(text_column).cast("string"), F.lit(""))
                      .alias("_text"))
    # the sample has a fixed bound, so its ids can go to every task
    chosen = own.join(F.broadcast(sample), "_id")

    def vectors(batches):
        for batch in batches:
            for row, data, bounds in rolling.slices(batch.column("_text")):
                n = len(bounds) - 1
                document, at = features(data, bounds)
                pairs = np.unique(document * SIZE + at)
                cuts = np.searchsorted(pairs, np.arange(n + 1) * SIZE)
                coordinates = (pairs % SIZE).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(row, n), batch.column("_label").slice(row, n),
                     pa.array([coordinates[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                    ["_id", "_label", "_at"])

    shards = max(1, round(min(SAMPLE, total) / SHARD_ROWS))
    shard = F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(shards)).cast("int").alias("shard")
    rows = keep(chosen.select("_id", "_label", "_text").mapInArrow(vectors, "_id long, _label int, _at binary")
                .select("_label", "_at", "_id", shard))
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))
        changes = rows.groupBy("shard").applyInArrow(_shard_pass(state), "at long, dz double, dn double")
        summed = changes.groupBy("at").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toPandas()  # SIZE rows at most
        z, n = z.copy(), n.copy()
        z[summed["at"]] += summed["dz"] / shards
        n[summed["at"]] += summed["dn"] / shards
    w = weights_of(z, n)
    w[SIZE] = weights_of(z[SIZE:], n[SIZE:], 0.0)[0]
    return w


def scored(docs: DataFrame, weights: np.ndarray | None, text_column: str = "text") -> DataFrame:
    """``_row`` (the input row) and ``score``."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"))
    if weights is None:
        return rows.select("_row", F.lit(0.0).alias("score"))
    kept = np.flatnonzero(weights[:SIZE])
    sent = docs.sparkSession.sparkContext.broadcast((kept, weights[kept], float(weights[SIZE])))

    def apply(batches):
        at, values, bias = sent.value
        table = np.zeros(SIZE)
        table[at] = values
        for batch in batches:
            sums = np.full(batch.num_rows, bias)
            for row, data, bounds in rolling.slices(batch.column("_text")):
                document, own = features(data, bounds)
                hit = np.flatnonzero(table[own])
                pairs = np.unique(document[hit] * SIZE + own[hit])
                np.add.at(sums, row + pairs // SIZE, table[pairs % SIZE])
            score = 1.0 / (1.0 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(score)], ["_row", "score"])

    return rows.mapInArrow(apply, rows.select("_row").schema.add("score", "double"))
