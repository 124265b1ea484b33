"""Token ids of whole texts, with each distinct piece of text encoded once per worker.

Byte-level BPE splits a text at borders that its pre-tokenizer pattern fixes, and encodes what lies between on its own. Some
of these borders can be seen from two neighbouring bytes: before a blank that stands before a visible character, between a
visible byte and white space, and between an ASCII letter or digit and ASCII punctuation other than the apostrophe. Texts are
cut there by array operations, pieces are told apart by rolling hashes, and only pieces that the worker has not met yet go
to the tokenizers library. Texts with white space outside ASCII or with a special token's name go to the library whole, and
so does a text whose pieces do not add up to its length.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tallgrid.llm import rolling

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

KNOWN_LIMIT = 4_000_000  # pieces that a worker remembers; beyond, it starts anew
_GLYPH = np.zeros(256, bool)
_GLYPH[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not _GLYPH[b] and b != 39]] = True
_WIDE_SPACE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                                               0x3000))
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The ids of one tokenizer file, with what the worker knows already."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        # in a byte-level vocabulary every character stands for one byte
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.widths[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint16 if len(self.widths) <= 1 << 16 else np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.ids.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.hashes) + len(pieces) > KNOWN_LIMIT:
            self._forget()
        spaced = [p[:1].isspace() + p[1:2].isspace() > 1 or p[-1:].isspace() for p in pieces]
        plain = [k for k, odd in enumerate(spaced) if not odd]
        found: list[np.ndarray] = [None] * len(pieces)
        for at in range(0, len(plain), 4096):
            part = plain[at:at + 4096]
            # a line break between two pieces is a pre-token of its own
            ids = self.whole(["\n".join([pieces[k].decode() for k in part])])[0]
            ends = np.cumsum(self.widths[ids])
            sizes = np.cumsum([len(pieces[k]) + 1 for k in part])
            cuts = np.searchsorted(ends, sizes - 1) + 1
            begin = np.append(0, cuts[:-1] + 1)
            if not (ends[cuts - 1] == sizes - 1).all():
                for k, ids in zip(part, self.whole([pieces[k].decode() for k in part])):
                    found[k] = ids
                continue
            for k, a, b in zip(part, begin.tolist(), cuts.tolist()):
                found[k] = ids[a:b]
        rest = [k for k, odd in enumerate(spaced) if odd]
        for k, ids in zip(rest, self.whole([pieces[k].decode() for k in rest])):
            found[k] = ids
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        sizes = np.concatenate([np.diff(self.starts), [len(f) for f in found]]).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        self.ids = gather(np.concatenate([self.ids, *found]), begin[order], sizes[order])
        self.hashes = np.concatenate([self.hashes, hashes])[order]
        self.starts = np.append(0, np.cumsum(sizes[order]))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the documents of one slice, end to end, and where each document's begin."""
        n = len(data)
        if n == 0:
            return self.ids[:0], np.zeros(len(bounds), np.int64)
        space, glyph, mark = rolling.SPACE[data], _GLYPH[data], _MARK[data]
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        if n > 1:
            cut[1:n] |= space[1:] & ~space[:-1]
            cut[1:n] |= glyph[:-1] & mark[1:]
            cut[1:n - 1] |= (data[1:-1] == 32) & ~space[2:]
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], n)
        hashes = rolling.Prefix(data).ranges(starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        if not known.all():
            text, new = data.tobytes(), first[~known]
            self._learn(distinct[~known], [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.hashes, distinct)
            lost = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct)
            if len(lost):  # forgotten while learning
                missing = first[lost]
                self._learn(distinct[lost], [text[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist())])
                at = np.searchsorted(self.hashes, distinct)
        sizes = np.diff(self.starts)[at][which]
        ids = gather(self.ids, self.starts[at][which], sizes)
        begin = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, bounds)]
        return self._checked(ids, begin, data, bounds)

    def _checked(self, ids, begin, data, bounds):
        widths = np.append(0, np.cumsum(self.widths[ids]))[begin]
        redo = np.diff(widths) != np.diff(bounds)
        lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        unsure = np.zeros(len(bounds) - 1, bool)
        unsure[np.searchsorted(bounds, lead, "right") - 1] = True
        text = data.tobytes()
        for i in np.flatnonzero(unsure):
            part = text[bounds[i]:bounds[i + 1]]
            redo[i] |= any(s in part for s in _WIDE_SPACE)
        for special in self.specials:
            at = text.find(special)
            while at >= 0:
                redo[np.searchsorted(bounds, at, "right") - 1] = True
                at = text.find(special, at + 1)
        if not redo.any():
            return ids, begin
        parts = [ids[a:b] for a, b in zip(begin[:-1], begin[1:])]
        rows = np.flatnonzero(redo)
        for i, own in zip(rows, self.whole([text[bounds[i]:bounds[i + 1]].decode() for i in rows])):
            parts[i] = own
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


def gather(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches values[begin : begin + size], end to end."""
    total = int(sizes.sum())
    offset = np.cumsum(sizes) - sizes
    return values[np.repeat(begin - offset, sizes) + np.arange(total)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str, end_id: int):
    """(first row, ids, bounds) of slices of a text column, each document closed by ``end_id``; null is empty."""
    own = encoder(path)
    for row, data, bounds in rolling.slices(column):
        ids, begin = own.encode(data, bounds)
        n = len(bounds) - 1
        out = np.full(len(ids) + n, end_id, ids.dtype)
        place = np.ones(len(out), bool)
        place[begin[1:] + np.arange(n)] = False
        out[place] = ids
        yield row, out, begin + np.arange(n + 1)
