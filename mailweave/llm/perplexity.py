"""Operator 6, quality rules: n-gram perplexity bands per language, with simple repetition and length rules.

The model is an interpolated modified Kneser-Ney trigram model over lower-cased
words, for every language with labelled rows. It is counted over all different
texts of good labelled documents (quality 1, not toxic) of ``SHORT`` words or more,
whole (:mod:`kneser_ney`). They are dealt into two folds, and each language has a model
of either. Documents that share half of all their 5-word windows stand in one fold. A
document's log-perplexity is the higher one of both models, so neither it nor a
copy of it, labelled or not, is judged by a model that has seen it.

The log-perplexities of all these documents, one of each group of near copies, set
the bands: median +- ``width`` robust standard deviations, both taken over cells of
1 / ``CELLS``, and below ``FEW`` documents at least the farthest of them. Documents
are scored whole, in ``ROUNDS`` parts or more of them that follow one another, so that the lists of
n-grams they ask for take a part of the disk only.

Words are runs outside ``\\x20 \\x09-\\x0D``. A null or empty text has no words and
fails. A language with fewer than ``LEAST`` different such documents has no
band; it, or a null language, has no perplexity that could be judged: only the
simple rules decide. Repeated rows are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailweave.llm import kneser_ney, ngram_join
from mailweave.llm.kneser_ney import BEGIN, FOLDS, PART_BYTES, chain, discounts, lowered_words
from mailweave.llm.store import free, materialise
from mailweave.llm.tables import sieved
from mailweave.llm.text import U64, as_bytes, delta, join_texts, mix, pack_arrays, ranked, text_slices, unpack_arrays, word_keys

#: Words that a document of the models has at least, the fewest documents that give a band, and those that give a robust one.
SHORT, LEAST, FEW = 50, 5, 20
#: Cells of a nat in which medians are taken, and documents of a language up to which folds are dealt in turn.
CELLS, IN_TURN = 4096, 1024
#: Parts of the documents that are scored one after another.
ROUNDS = 4
_SYMBOLS = b"#*$%&|<>"
#: What is no first byte of a code point in a word.
_NO_CHARS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])


@dataclass
class Model:
    """A model held in memory: sorted hashes of 1-, 2- and 3-grams with log probabilities, and back-off weights of contexts.

    What is counted in parts is held against it; queries don't use it.
    """

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    context: list[np.ndarray]
    backoff: list[np.ndarray]
    unknown: float

    def score(self, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each word; ``first`` marks the first word of a text."""
        h1 = np.concatenate(([BEGIN], w[:-1])) if len(w) else w
        h1 = np.where(first, BEGIN, h1)
        h2 = np.concatenate(([BEGIN], h1[:-1])) if len(w) else w
        h2 = np.where(first, BEGIN, h2)
        out = self._find(self.keys[0], self.logp[0], w, self.unknown)
        pair = chain(h1, w)
        hit = self._at(self.keys[1], pair)
        lower = out + self._find(self.context[0], self.backoff[0], h1, 0.0)
        out, own = lower, hit >= 0
        out[own] = self.logp[1][hit[own]]
        context = chain(h2, h1)
        known = self._at(self.context[1], context)
        at = np.flatnonzero(known >= 0)
        triple = self._at(self.keys[2], chain(context[at], w[at]))
        out[at] += self.backoff[1][known[at]]
        out[at[triple >= 0]] = self.logp[2][triple[triple >= 0]]
        return out

    @staticmethod
    def _at(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Where each hash stands in a sorted array, or -1."""
        if not len(keys):
            return np.full(len(want), -1)
        if keys.dtype == np.uint32:
            want = (want >> U64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, at, -1)

    def packed(self) -> bytes:
        """A small form: the upper 32 bits of the hashes, values in half precision."""
        parts = [np.array([self.unknown], np.float64).view(np.uint64)]
        for keys, values in zip([*self.keys, *self.context], [*self.logp, *self.backoff], strict=True):
            short, first = np.unique((keys >> U64(32)).astype(np.uint32), return_index=True)
            parts += [delta(short), values[first].astype(np.float16).view(np.uint16)]
        return pack_arrays(*parts)

    @staticmethod
    def unpacked(raw: bytes) -> Model:
        first, *parts = unpack_arrays(raw)
        keys = [np.cumsum(x, dtype=np.uint32) for x in parts[::2]]
        values = [x.view(np.float16).astype(np.float32) for x in parts[1::2]]
        return Model(keys[:3], values[:3], keys[3:], values[3:], float(first.view(np.float64)[0]))

    def _find(self, keys: np.ndarray, values: np.ndarray, want: np.ndarray, default: float) -> np.ndarray:
        at = self._at(keys, want)
        return np.where(at >= 0, values[at], default) if len(keys) else np.full(len(want), default)


def fit(h2: np.ndarray, h1: np.ndarray, w: np.ndarray, n: np.ndarray) -> Model:
    """Interpolated modified Kneser-Ney estimates from distinct trigrams (h2, h1, w) and their counts."""

    def reduced(counts: np.ndarray) -> np.ndarray:
        return discounts([int((counts == i).sum()) for i in range(1, 5)])[np.minimum(counts, 3)]

    def group(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
        key = columns[0]
        for c in columns[1:]:
            key = chain(key, c)
        return np.unique(key, return_index=True, return_inverse=True)

    def level(context: np.ndarray, counts: np.ndarray, lower: np.ndarray):
        """Probabilities, contexts (sorted) and the logarithms of their back-off weights."""
        d = reduced(counts)
        keys, of = np.unique(context, return_inverse=True)
        total = np.bincount(of, counts)
        gamma = np.bincount(of, d) / total
        return (counts - d) / total[of] + gamma[of] * lower, keys, np.log(gamma).astype(np.float32)

    # Bigrams count the words that precede them, single words the distinct bigrams; at a text's start counts are plain.
    k2, i2, of2 = group(h1, w)
    c2 = np.where(h1[i2] == BEGIN, np.bincount(of2, n).astype(np.int64), np.bincount(of2))
    k1, _, of1 = group(w[i2])
    c1 = np.bincount(of1)
    d1 = reduced(c1)
    spread = d1.sum() / c1.sum() / (len(c1) + 1)
    p1 = (c1 - d1) / c1.sum() + spread
    p2, ctx1, bo1 = level(h1[i2], c2, p1[of1])
    k3, i3, _ = group(chain(h2, h1), w)
    p3, ctx2, bo2 = level(chain(h2, h1)[i3], n[i3], p2[of2[i3]])
    log = lambda x: np.log(x).astype(np.float32)
    return Model([k1, k2, k3], [log(p1), log(p2), log(p3)], [ctx1, ctx2], [bo1, bo2], float(np.log(spread)))


def log_perplexity(texts: list[bytes], model: Model) -> np.ndarray:
    """Mean negative log probability per word of each text; NaN without words."""
    h, at = lowered_words(texts)
    first = np.zeros(len(h), bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    total = np.concatenate(([0.0], np.cumsum(-model.score(h, first), dtype=np.float64)))
    n = np.diff(at)
    return np.where(n > 0, (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1), np.nan)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Distinct trigrams (h2, h1, w) of some texts, and their counts."""
    h, at = lowered_words(texts)
    h1, h2 = np.roll(h, 1), np.roll(h, 2)
    n = np.diff(at)
    first = at[:-1][n > 0]
    h1[first] = h2[first] = BEGIN
    h2[at[:-1][n > 1] + 1] = BEGIN
    _, i, c = np.unique(chain(chain(h2, h1), h), return_index=True, return_counts=True)
    return h2[i], h1[i], h[i], c


@dataclass
class Language:
    """The band of a language."""

    low: float
    high: float


@dataclass
class Judge:
    """All languages that have a band, and the counts of their models."""

    models: dict[str, Language] = field(default_factory=dict)
    counts: kneser_ney.Counts | None = None

    def close(self) -> None:
        """Delete the counts: nothing is judged any more."""
        if self.counts:
            free(*self.counts.tables)


def size_of(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def eligible(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, text, lang): all different texts of good documents of each language; h is a hash of both."""
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL")
    long = F.col("text").rlike(rf"^[ \t-\r]*+(?:[^ \t-\r]++[ \t-\r]++){{{SHORT - 1}}}[^ \t-\r]")
    found = sieved(known, good, "doc_id").join(good.hint("merge"), "doc_id").where(long)
    return materialise(found.select(F.xxhash64("lang", "text").alias("h"), "text", "lang").dropDuplicates(["lang", "h"]), "eligible")


def folded(texts: DataFrame) -> DataFrame:
    """Those texts with their fold, which near copies share, and whether it is the first of its group."""
    lowered = texts.select(F.col("h").alias("doc_id"), F.lower("text").alias("text"))
    near = ngram_join.near_copies(lowered, threshold=0.5, recall=0.99).select(F.col("doc_id").alias("h"), F.col("class_id").alias("group"))
    near = materialise(texts.select("h", "lang").join(near.hint("merge"), "h"), "near")
    groups = materialise(near.select("lang", "group").distinct(), "groups")
    # Languages of few groups, which hashes might all deal to one fold, are dealt in turn; a window then has IN_TURN rows at most.
    few = groups.groupBy("lang").count().where(F.col("count") <= IN_TURN).select("lang")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("group"), "group"))
    dealt = groups.join(few, "lang", "left_semi").select("lang", "group", (turn % FOLDS).cast("int").alias("fold"))
    dealt = dealt.union(groups.join(few, "lang", "left_anti").select("lang", "group", F.pmod(F.xxhash64("group"), F.lit(FOLDS)).cast("int").alias("fold")))
    about = near.join(dealt.hint("merge"), ["lang", "group"]).select("h", "fold", (F.col("h") == F.col("group")).alias("first"))
    return texts.join(about.hint("merge"), "h").select("text", "lang", "fold", "first")


def bands(values: DataFrame, width: float, slack: float) -> dict[str, Language]:
    """The band of each language of ``values`` (lang, cell, n): how many documents have a log-perplexity in that cell."""

    def median(x: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(x)
        ends = np.cumsum(n[order])
        low, high = np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], side="right")
        return float(x[order[low]] + x[order[high]]) / 2

    def run(table: pa.Table) -> pa.Table:
        x, n = table["cell"].to_numpy() / CELLS, table["n"].to_numpy()
        if n.sum() < LEAST:
            return pa.table({"lang": pa.array([], pa.string()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
        middle = median(x, n)
        far = np.abs(x - middle)
        reach = max(width * 1.4826 * median(far, n), float(far.max()) if n.sum() < FEW else 0.0) + slack
        return pa.table({"lang": table["lang"].combine_chunks()[:1], "low": [middle - reach], "high": [middle + reach]})

    found = values.groupBy("lang").applyInArrow(run, "lang string, low double, high double").collect()
    return {r["lang"]: Language(r["low"], r["high"]) for r in sorted(found)}


def train(docs: DataFrame, labels: DataFrame, width: float = 6.0, slack: float = 0.25) -> Judge:
    """Count the models of all good labelled documents and set the band of every language by all of them."""
    texts = eligible(docs, labels)
    own = size_of(texts)
    blocks = kneser_ney.blocks_of(folded(texts), "text", "lang")
    free(texts)
    counts = kneser_ney.count(blocks, max(own, size_of(docs) // ROUNDS))

    def run(lang: str, rows: pa.RecordBatch, values: np.ndarray) -> pa.Table:
        cells = np.rint(values[rows.column("first").to_numpy(zero_copy_only=False)] * CELLS).astype(np.int64)
        cells, n = np.unique(cells, return_counts=True)
        return pa.table({"lang": pa.array([lang] * len(cells), pa.string()), "cell": cells, "n": n})

    values = kneser_ney.scored(blocks, counts, run, "lang string, cell long, n long", "cells")
    judge = Judge(bands(values.groupBy("lang", "cell").agg(F.sum("n").alias("n")), width, slack), counts)
    free(blocks, values)
    return judge


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double, kept boolean"
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", "kept"]


def repeated_words(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text, words in 3-word windows found twice or more in it."""
    out = np.zeros(len(at) - 1, np.int64)
    if len(h) < 3:
        return out
    n = np.diff(at)
    of = np.repeat(np.arange(len(n)), n)
    inside = of[:-2] == of[2:]
    key = mix(((h[:-2] * U64(0x9E3779B97F4A7C15) + h[1:-1]) * U64(0x9E3779B97F4A7C15) + h[2:]) ^ mix(of[:-2].astype(U64)))
    where = np.flatnonzero(inside)
    where = where[ranked(key[inside])]
    key = key[where]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[where[twice] + k] = True
    total = np.concatenate(([0], np.cumsum(covered)))
    return total[at[1:]] - total[at[:-1]]


def measure(texts: list[bytes], ppl: np.ndarray, band: Language | None) -> list[np.ndarray]:
    """The columns of OUT for some texts of one language and their log-perplexities."""
    buf, starts = join_texts(texts)
    h, s, _ = word_keys(buf)
    at = np.searchsorted(s, starts)
    n = np.diff(at)
    chars = np.array([len(t.translate(None, _NO_CHARS)) for t in texts], np.int64)
    symbols = np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64)
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            dup[i] = len(lines) - len(set(lines))
    repeat = repeated_words(h, at)
    failed = (n < 50) | (100 * repeat > 50 * n)
    kept = ~failed
    if band:
        kept &= (ppl >= band.low) & (ppl <= band.high)
    return [n, chars, symbols, dup, repeat, failed, ppl, kept]


def judged(docs: DataFrame, judge: Judge, run: Callable, schema: str, name: str) -> DataFrame:
    """``run(rows, columns of OUT)`` of all rows of ``docs``, which has a text and a lang, written in rounds."""
    models = judge.models

    def each(lang: str | None, rows: pa.RecordBatch, ppl: np.ndarray) -> pa.Table:
        texts = as_bytes(rows.column("text"))
        parts = [measure(texts[i:j], ppl[i:j], models.get(lang)) for i, j in text_slices(texts, 1 << 18)]
        return run(rows, [np.concatenate(x) for x in zip(*parts, strict=True)])

    counts = judge.counts or kneser_ney.Counts([docs.sparkSession.createDataFrame([], kneser_ney.ROW)] * 3, [1] * 3, {})
    rounds = max(ROUNDS, size_of(docs) // (counts.parts[2] * PART_BYTES) + 1)
    out = None
    for k in range(rounds):
        blocks = kneser_ney.blocks_of(docs.where(F.pmod(F.xxhash64("doc_id", "text", "lang"), F.lit(rounds)) == k), "text", "lang", set(models))
        part = kneser_ney.scored(blocks, counts, each, schema, name)
        free(blocks)
        out = part if out is None else out.union(part)
    return out


def quality(docs: DataFrame, judge: Judge) -> DataFrame:
    """One row per document: its measures, perplexity and verdict."""

    def run(rows: pa.RecordBatch, columns: list[np.ndarray]) -> pa.Table:
        arrays = [pa.array(c, mask=np.isnan(c)) if c.dtype == np.float64 else pa.array(c) for c in columns]
        return pa.Table.from_arrays([rows.column("doc_id").cast(pa.int64()), *arrays], ["doc_id", *_NAMES])

    return judged(docs.select("doc_id", "text", "lang"), judge, run, "doc_id long, " + OUT, "judged")


def keep_good(docs: DataFrame, judge: Judge) -> DataFrame:
    """The documents that pass, with all their columns."""

    def run(rows: pa.RecordBatch, columns: list[np.ndarray]) -> pa.Table:
        return pa.Table.from_batches([rows.filter(pa.array(columns[-1]))])

    return judged(docs, judge, run, docs.schema, "good")
