"""Whole-text encoding with the tokenizers library, remembering the ids of units.

A unit is a run of bytes outside ``\\x20 \\x09-\\x0D``, with the white space before it
where the vocabulary keeps white space (what is left at a text's end is a unit
of its own there). Both vocabularies cut a text at that white space before
anything else, so a unit has the same ids alone as in its text; special tokens
hold no white space and stay within a unit. The one exception are other Unicode
white-space characters under a vocabulary that keeps white space, as they join
the white space around them: texts with one go to the library whole.

Units are known by 64-bit fingerprints in an open-addressing table; only units not
met before go to the library, and a slice of texts costs a few numpy passes.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from mailweave.llm.text import U64, WHITE, join_texts, mix, powers, prefix, text_slices

#: UTF-8 of the white-space characters outside ASCII.
_WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Where a longer text may be cut: no rule of either vocabulary looks across.
_SAFE_CUT = re.compile(b"[A-Za-z0-9](?= [A-Za-z0-9])")
#: Bytes of text encoded at a time; units and ids remembered per worker.
SLICE, MOST_UNITS, MOST_IDS = 1 << 20, 1 << 21, 1 << 25


class Encoder:
    """Ids of whole texts under one tokenizer file, as little-endian unsigned integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced = self.tokenizer.normalizer is None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(1 << 16, U64)  # 0 stands for a free slot
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.units = np.zeros(0, self.dtype), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each fingerprint, or -1."""
        mask = U64(len(self.keys) - 1)
        at = (h & mask).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, at, -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            key = self.keys[at[open_]]
            hit = key == h[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (key != 0)]
        return out

    def _insert(self, h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Add distinct fingerprints that are not in the table."""
        while 2 * (self.units + len(h)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            old = self.keys[used], self.begin[used], self.size[used]
            n = 2 * len(self.keys)
            self.keys, self.begin, self.size, self.units = np.zeros(n, U64), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
            self._insert(*old)
        self.units += len(h)
        mask = len(self.keys) - 1
        at, rest = (h & U64(mask)).astype(np.int64), np.arange(len(h))
        while len(rest):
            free = self.keys[at[rest]] == 0
            self.keys[at[rest[free]]] = h[rest[free]]
            won = self.keys[at[rest]] == h[rest]
            own = rest[won]
            self.begin[at[own]], self.size[at[own]] = begin[own], size[own]
            rest = rest[~won]
            at[rest] = (at[rest] + 1) & mask

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _learn(self, h: np.ndarray, units: list[bytes]) -> None:
        found = self._library(units)
        size = np.array([len(x) for x in found], np.int64)
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, np.array([i for x in found for i in x], self.dtype)))
        self._insert(h, begin, size)

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, each with ``end_id`` at its end if that is given, and how many each text has."""
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, j in text_slices(texts, SLICE):
            plain = i
            for k in range(i, j + 1):
                if k < j and len(texts[k]) <= 2 * SLICE and not (self.spaced and _WIDE_SPACE.search(texts[k])):
                    continue
                if plain < k:
                    ids, sizes[plain:k] = self._slice(texts[plain:k])
                    parts.append(ids)
                if k < j:
                    own = list(self._long(texts[k]))
                    sizes[k] = sum(map(len, own))
                    parts += own
                plain = k + 1
        ids = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
        return ids, sizes

    def _long(self, text: bytes):
        """Ids of a text of any length, some slices at a time."""
        i = 0
        while i < len(text):
            cut = _SAFE_CUT.search(text, i + SLICE) if len(text) - i > 2 * SLICE else None
            part = text[i : cut.end() if cut else len(text)]
            if self.spaced and _WIDE_SPACE.search(part):
                yield np.array(self._library([part])[0], self.dtype)
            else:
                yield self._slice([part])[0]
            i += len(part)

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.units > MOST_UNITS or len(self.ids) > MOST_IDS:
            self._forget()
        buf, at = join_texts(texts)
        a = np.frombuffer(buf, np.uint8)
        solid = np.zeros(len(a) + 2, np.int8)
        solid[1:-1] = ~WHITE[a]
        edge = np.diff(solid)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bounds = np.searchsorted(s, at)
        if self.spaced:
            left = np.concatenate(([0], e[:-1])) if len(e) else e
            some = bounds[:-1] < bounds[1:]
            left[bounds[:-1][some]] = at[:-1][some]
            tail = at[:-1].copy()
            tail[some] = e[bounds[1:][some] - 1]
            rest = np.flatnonzero(tail < at[1:] - 1)
            s, e = np.insert(left, bounds[1:][rest], tail[rest]), np.insert(e, bounds[1:][rest], at[1:][rest] - 1)
            bounds = bounds + np.concatenate(([0], np.cumsum(np.isin(np.arange(len(texts)), rest))))
        p = prefix(a)
        h = np.maximum(mix((p[e] - p[s]) * powers(len(a) + 1)[1][s]), U64(1))
        slot = self._find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            self._learn(keys, [buf[s[k] : e[k]] for k in new[first]])
            slot = self._find(h)  # slots move when the table grows
        size = self.size[slot]
        ends = np.concatenate(([0], np.cumsum(size)))
        from_ = np.repeat(self.begin[slot] - ends[:-1], size)
        from_ += np.arange(len(from_))
        return self.ids[from_], np.diff(ends[bounds])


def binary_rows(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value per text over the bytes of all ids, without a copy per text."""
    offsets = np.concatenate(([0], np.cumsum(sizes) * ids.dtype.itemsize))
    kind, of = (pa.binary(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets.astype(of)), pa.py_buffer(np.ascontiguousarray(ids))])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of one tokenizer file, made once per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
