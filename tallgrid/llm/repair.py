"""Binary token output: Re-Pair grammar compression of id streams, in blocks that decode on their own.

Documents are dealt out by ranges of their ids and sorted, encoded, and written in blocks of about ``BLOCK`` ids. Within a block
frequent pairs of neighbouring symbols are replaced by nonterminals, many pairs at a time: a round takes pairs in falling
frequency as long as no taken pair starts with a symbol that another ends with, so that no two replacements overlap. Rounds end
when one saves less than a hundredth. A block stores its rules, the expansion length of each rule, the remaining symbols and
the running expansion length at every ``STRIDE``-th of them: any range of ids is decoded from a few symbols.

A file is a Parquet file of such blocks; its shard number and the blocks' numbers give the order of the ids. The committer of
the table makes lost tasks harmless.

Defined cases: a null text is empty and yields the end id; documents with one id are ordered by their texts' hash; a null id
comes last; an empty table gives no blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrid.llm import spans, tokens
from tallgrid.llm.shared import keep, partitions, prepare

BLOCK, STRIDE = 1 << 20, 1024
PAIRS, LEAST, SLOTS = 4096, 8, 18
FILE = ("shard int, block int, start long, n_tokens long, base long, doc_ids binary, doc_sizes binary, rules binary, "
        "rule_lengths binary, symbols binary, marks binary")


def compress(ids: np.ndarray, base: int, limit: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k stands for the pair rules[k] and is named ``base + k``; names stay below ``limit``."""
    symbols, rules, free = ids.astype(np.uint32), [], base
    while len(symbols) > 1 and free < limit:
        keys = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
        slots = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int32)
        counts = np.bincount(slots, minlength=1 << SLOTS)
        bar = max(LEAST, int(np.partition(counts, -PAIRS)[-PAIRS]))
        places = np.flatnonzero(counts[slots] >= bar)
        pairs, which, often = np.unique(keys[places], return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        first, second, taken = set(), set(), np.full(len(pairs), -1, np.int64)
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        n = 0
        for k in order[:2 * PAIRS].tolist():
            x, y = int(left[k]), int(right[k])
            if often[k] < LEAST or free + n >= limit:
                break
            if x != y and x not in second and y not in first:
                first.add(x)
                second.add(y)
                taken[k] = free + n
                rules.append((x, y))
                n += 1
        if not n:
            break
        names = taken[which]
        hit = names >= 0
        at = places[hit]
        symbols[at] = names[hit]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols = symbols[stay]
        free += n
        if len(at) * 100 < len(stay):
            break
    return np.array(rules, np.uint32).reshape(-1, 2), symbols


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, begin, size): what every symbol stands for; rules only name earlier symbols."""
    size = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])
    values, begin = rules.reshape(-1), np.arange(0, 2 * len(rules) + 1, 2)
    while (deep := values >= base).any():
        at = np.flatnonzero(deep)
        steps = np.ones(len(values), np.int64)
        steps[at] = 2
        place = np.cumsum(steps) - steps
        wider = np.repeat(values, steps)
        inner = rules[values[at].astype(np.int64) - base]
        wider[place[at]], wider[place[at] + 1] = inner[:, 0], inner[:, 1]
        begin = np.append(place, len(wider))[begin]
        values = wider
    terminals = np.arange(base, dtype=np.uint32)
    return np.concatenate([terminals, values]), np.concatenate([np.arange(base), base + begin[:-1]]), size


def decode(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, base: int) -> np.ndarray:
    values, begin, size = expansions(rules, lengths, base)
    symbols = symbols.astype(np.int64)
    return tokens.gather(values, begin[symbols], size[symbols])


def decode_range(rules, lengths, symbols, marks, base: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end - 1`` of a block, from the symbols that hold them."""
    a = max(0, int(np.searchsorted(marks, start, "right")) - 1)
    b = int(np.searchsorted(marks, end, "left"))
    part = decode(rules, lengths, symbols[a * STRIDE:b * STRIDE], base)
    return part[start - int(marks[a]):end - int(marks[a])]


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(base + len(rules), np.int64)
    for k, (x, y) in enumerate(rules.tolist(), base):
        out[k] = out[x] + out[y]
    return out[base:].astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
                 end_id: int = 0) -> DataFrame:
    """Encode ``docs`` in ascending order of ids into a new table of block files; returns the table as read back."""
    prepare(docs.sparkSession)
    documents = spans.keyed(docs, id_column, text_column).drop("_row")
    ordered = (documents.repartitionByRange(partitions(docs.sparkSession), "_id", "_key")
               .sortWithinPartitions("_id", "_key"))

    def apply(batches):
        from pyspark import TaskContext

        shard, block, start, base = TaskContext.get().partitionId(), 0, 0, len(tokens.encoder(tokenizer).widths)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            own, sizes, ids = (np.concatenate(c) for c in zip(*held))
            rules, symbols = compress(ids, base)
            lengths = rule_lengths(rules, base)
            every = np.append(np.ones(base, np.int64), lengths)[symbols]
            marks = np.append(0, np.cumsum(every))[:-1:STRIDE]
            row = {"shard": shard, "block": block, "start": start, "n_tokens": len(ids), "base": base,
                   "doc_ids": own.astype("<i8").tobytes(), "doc_sizes": sizes.astype("<u4").tobytes(),
                   "rules": rules.astype("<u2").tobytes(), "rule_lengths": lengths.astype("<u4").tobytes(),
                   "symbols": symbols.astype("<u2").tobytes(), "marks": marks.astype("<u4").tobytes()}
            schema = pa.schema([(k, pa.int32() if k in ("shard", "block") else pa.binary() if isinstance(v, bytes)
                                 else pa.int64()) for k, v in row.items()])
            return pa.RecordBatch.from_pylist([row], schema), len(ids)

        size = 0
        for batch in batches:
            own = batch.column("_id").to_numpy()
            for row, ids, bounds in tokens.encoded(batch.column("_text"), tokenizer, end_id):
                held.append((own[row:row + len(bounds) - 1], np.diff(bounds), ids))
                size += len(ids)
                if size >= BLOCK:
                    written, n = flush()
                    yield written
                    held, size, block, start = [], 0, block + 1, start + n
        if held:
            yield flush()[0]

    return keep(ordered.select("_id", "_text").mapInArrow(apply, FILE))


def parts_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(rules, rule lengths, symbols, marks, base) of one stored block."""
    return (np.frombuffer(row["rules"], "<u2").reshape(-1, 2).astype(np.uint32), np.frombuffer(row["rule_lengths"], "<u4"),
            np.frombuffer(row["symbols"], "<u2"), np.frombuffer(row["marks"], "<u4"), row["base"])


def read_shards(files: DataFrame) -> DataFrame:
    """``_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, decoded from the files."""
    def apply(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rules, lengths, symbols, _, base = parts_of(row)
                ids = decode(rules, lengths, symbols, base).astype("<u4")
                own, sizes = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_sizes"], "<u4").astype(np.int64)
                begin = np.append(0, np.cumsum(sizes))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), row["shard"], np.int32)), pa.array(own), pa.array(begin[:-1] + row["start"]),
                     pa.array(sizes), pa.array(crc, pa.int64())], ["shard", "_id", "own_start", "n_tokens", "ids_crc32"])

    decoded = files.mapInArrow(apply, "shard int, _id long, own_start long, n_tokens long, ids_crc32 long")
    sizes = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return decoded.join(bases, "shard").select("_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens",
                                               "ids_crc32")
