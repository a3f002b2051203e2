"""Operator 3, token counts: greedy longest-match piece counts without building pieces.

The vocabulary trie carries failure links and, with every link, how many pieces
are popped when it is taken. One pass over a word's bytes then gives the number
of pieces that greedy longest match would cut it into, in linear time.

A word (a run of bytes outside ``\\x20 \\x09-\\x0D``) is matched with one space
before it; vocabularies of byte-level tokenizers keep word-initial pieces with
that space. Every single byte is a piece, so no word is without a cut.

Null and empty texts have no words and no tokens. Repeated rows are counted
each on its own; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from mailweave.llm.text import as_bytes

#: Words remembered per Python worker, and the longest word that is remembered.
CACHE_WORDS, CACHE_BYTES = 400_000, 64


def load_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file with one base64 piece and its rank per line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """Trie with failure links over a vocabulary that holds all single bytes."""

    def __init__(self, vocabulary: list[bytes]):
        self.go: list[dict[int, int]] = [{}]
        piece = [False]
        for word in {*vocabulary, *(bytes([b]) for b in range(256))}:
            u = 0
            for c in word:
                v = self.go[u].get(c)
                if v is None:
                    v = self.go[u][c] = len(self.go)
                    self.go.append({})
                    piece.append(False)
                u = v
            piece[u] = u != 0
        n = len(self.go)
        self.fail, self.pops, self.rest = [0] * n, [0] * n, [0] * n
        level = [(0, c, v) for c, v in self.go[0].items()]
        while level:
            following = []
            for u, c, v in level:
                if piece[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while c not in self.go[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    self.fail[v], self.pops[v] = self.go[z][c], popped
                self.rest[v] = self.pops[v] + self.rest[self.fail[v]]
                following += [(v, d, w) for d, w in self.go[v].items()]
            level = following

    def count(self, word: bytes) -> int:
        """Number of pieces of greedy longest match."""
        go, fail, pops = self.go, self.fail, self.pops
        u = n = 0
        for c in word:
            while c not in go[u]:
                n += pops[u]
                u = fail[u]
            u = go[u][c]
        return n + self.rest[u]


class WordCounts(dict):
    """Counts of words seen before; starts anew when it is full."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


_COUNTS: dict[str, WordCounts] = {}


def word_counts(path: str) -> WordCounts:
    """The automaton of one vocabulary file, built once per worker process."""
    if path not in _COUNTS:
        _COUNTS[path] = WordCounts(LongestMatch(load_vocabulary(path)))
    return _COUNTS[path]


SCHEMA = "doc_id long, n_bytes long, n_words long, n_tokens long"


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: bytes, words and longest-match tokens of its whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_counts(vocabulary)
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                words = text.split()
                rows.append((len(text), len(words), sum(map(known.__getitem__, words))))
            sizes, words, tokens = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (sizes, words, tokens))],
                ["doc_id", "n_bytes", "n_words", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
