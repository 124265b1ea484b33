"""Steps that both substring operators use: reading documents as symbols, and cutting marked stretches out of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrid.llm import rolling
from tallgrid.llm.shared import order_id

PAIR = np.dtype([("start", ">u4"), ("count", ">u4")])


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``_id`` (order of documents), ``_key`` (tells rows of one id apart), ``_text`` and ``_row`` (the input row)."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(order_id(id_column).alias("_id"), F.hash(text).alias("_key"), text.alias("_text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


class Symbols:
    """The symbols of a slice of documents: bytes, or words by their hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, by_word: bool):
        if by_word:
            self.starts, self.ends, self.values, self.bounds = rolling.words(data, bounds)
        else:
            self.starts = self.ends = None
            self.values, self.bounds = data, bounds
        self.prefix = rolling.Prefix(self.values)


def per_document(document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and where the rows of each begin (with an end mark)."""
    first = np.flatnonzero(np.append(True, document[1:] != document[:-1])) if len(document) else np.zeros(0, np.int64)
    return document[first], np.append(first, len(document))


def blobs(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def pairs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), PAIR)
    out["start"], out["count"] = starts, counts
    return out


def whole_characters(gone: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Marks of bytes, spread over all bytes of a character that is marked in part."""
    character = np.cumsum((data & 0xC0) != 0x80)
    return (np.bincount(character, weights=gone) > 0)[character] if len(data) else gone


def cut_out(documents: DataFrame, marks: DataFrame, length: int, by_word: bool, text_column: str = "text",
            characters: bool = False) -> DataFrame:
    """The rows of ``keyed`` documents without the symbols that marked windows cover.

    With ``characters`` a character goes as a whole if one of its bytes does. The text travels once, inside its row.

    ``marks`` has ``_id``, ``_key`` and ``_pairs``, packed (first window, number of windows). Returns ``_row``, ``kept``
    (binary; words are joined by one blank), ``n_symbols``, ``n_removed`` and ``n_spans``.
    """
    per_row = marks.groupBy("_id", "_key").agg(F.collect_list("_pairs").alias("_marks"))
    text = F.coalesce(F.col(f"_row.`{text_column}`").cast("string"), F.lit("")).alias("_text")
    joined = documents.select("_id", "_key", "_row").join(per_row.hint("shuffle_hash"), ["_id", "_key"], "left").select(
        "_row", text, "_marks")
    schema = (joined.select("_row").schema.add("kept", "binary").add("n_symbols", "long").add("n_removed", "long")
              .add("n_spans", "long"))

    def apply(batches):
        for batch in batches:
            marked = batch.column("_marks")
            kept, sizes, removed, spans = [], [], [], []
            for row, data, bounds in rolling.slices(batch.column("_text")):
                if by_word:
                    starts, ends, _, limits = rolling.words(data, bounds)
                    text = data.tobytes()
                for i in range(len(bounds) - 1):
                    found = marked[row + i].as_py()
                    if by_word:
                        low, n = limits[i], int(limits[i + 1] - limits[i])
                    else:
                        n = int(bounds[i + 1] - bounds[i])
                    gone = np.zeros(n, bool)
                    if found:
                        at = np.frombuffer(b"".join(found), PAIR)
                        first = at["start"].astype(np.int64)
                        gone = rolling.covered(n, first, first + at["count"] + (length - 1))
                        if characters and not by_word:
                            gone = whole_characters(gone, data[bounds[i]:bounds[i + 1]])
                    stay = ~gone
                    if not by_word:
                        piece = data[bounds[i]:bounds[i + 1]]
                        kept.append((piece[stay] if found else piece).tobytes())
                    elif n == 0:
                        kept.append(b"")
                    else:
                        s, e = starts[low:low + n][stay], ends[low:low + n][stay]
                        kept.append(b" ".join([text[a:b] for a, b in zip(s.tolist(), e.tolist())]))
                    sizes.append(n)
                    removed.append(int(gone.sum()))
                    spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                ["_row", "kept", "n_symbols", "n_removed", "n_spans"])

    return joined.mapInArrow(apply, schema)


def sha256(column: str) -> Column:
    return F.sha2(F.col(column), 256)
