"""Operator 2, line dedup by a tree of line templates.

Lines (split at \\n) with a word are parsed by a tree of fixed depth: number of
words, then the leading ``depth`` words, where words that hold a digit, an @ or ://
count as variable, unless most words of the line do (rows of numbers are no template).
Forms of a leaf that agree in ``similarity`` of their words share
all words of one of a few segments, so each form is compared with the form of most
documents of each of its segments, and takes the one of most documents that it
agrees with as its template; a leaf may have any number of templates. Segments are
known by 64-bit hashes; words are fetched only for pairs of different forms.

A template recurs if ``min_docs`` different texts support it. A text supports the
templates of its lines only if lines of templates found in ``min_docs`` texts make up
at most ``most_share`` of its words: near copies of one document have nearly all
lines in common, so they support none, and are left to the near-duplicate operators.
So a template found only in texts that are mostly such lines stays. Lines of
recurring templates are dropped everywhere, in copies too.

Texts are parsed once; masked lines are written and all counts are partial
aggregates; a leaf is never gathered, and joins on a frequent line or text have one
row for it on the other side, so its rows can be split (AQE skew join). Whole texts
are shuffled once, to meet their verdict. Words are runs outside ``\\x20 \\x09-\\x0D``.
A null text stays null, a text without recurring lines stays as it is, a text of
recurring lines only becomes empty. Equal texts count once and get the same answer.
Ties for the form of most documents go to the largest hash. All columns are kept,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.store import free, materialise
from mailweave.llm.tables import fresh
from mailweave.llm.text import as_bytes, give_back

DEPTH, SIMILARITY, MIN_DOCS, MOST_SHARE = 3, 0.8, 5, 0.7
BUCKETS = 1 << 18
_VARIABLE = re.compile(rb"[0-9@]|://")


def masked_lines(text: bytes) -> list[tuple[int, int, bytes]]:
    """(place, number of words, words with variable ones masked) of every line with a word."""
    out = []
    for pos, line in enumerate(text.split(b"\n")):
        words = line.split()
        if words:
            if _VARIABLE.search(line):
                masked = [b"<*>" if _VARIABLE.search(w) else w for w in words]
                words = masked if 2 * masked.count(b"<*>") <= len(words) else words
            out.append((pos, len(words), b" ".join(words)))
    return out


def line_table(texts: DataFrame, depth: int) -> DataFrame:
    """(key, total, pos, n, leaf, form, masked) of every line with a word; total: the words of its text."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            rows: list[tuple] = []
            size = 0
            for key, text in zip(keys, texts, strict=True):
                lines = masked_lines(text)
                total = sum(n for _, n, _ in lines)
                rows += [(key, total, *line) for line in lines]
                size += len(text)
                if size > 4 << 20:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)
        give_back()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays[:4], arrays[4].cast(pa.string())], ["key", "total", "pos", "n", "masked"])

    rows = texts.select("key", "text").mapInArrow(parse, "key long, total long, pos int, n int, masked string")
    return rows.withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", depth))).withColumn("form", F.xxhash64("masked"))


def segments(words: list[bytes], depth: int, allowed: int) -> Iterator[bytes]:
    """Every (allowed + 1)-th word after the leading ones, from each of the first allowed + 1; read once in all."""
    step = allowed + 1
    for s in range(step):
        yield b" ".join(words[s + -(-max(depth - s, 0) // step) * step :: step])


def segment_table(forms: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(leaf, form, docs, segment) of forms(leaf, form, n, masked, docs); a segment is known by a hash, so rows stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for leaf, form, n, docs, masked in zip(*(c.to_pylist() for c in batch.columns[:4]), as_bytes(batch.column(4)), strict=True):
                allowed = math.floor((1 - similarity) * n + 1e-9)
                head = struct.pack("<q", leaf)
                for s, x in enumerate(segments(masked.split(b" "), depth, allowed)):
                    rows.append((leaf, form, docs, int.from_bytes(hashlib.blake2b(b"%s%d %s" % (head, s, x), digest_size=8).digest(), "little", signed=True)))
                if len(rows) > 1 << 16:
                    yield made(rows)
                    rows = []
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["leaf", "form", "docs", "segment"])

    return forms.select("leaf", "form", "n", "docs", "masked").mapInArrow(run, "leaf long, form long, docs long, segment long")


def templates(forms: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(leaf, form, template) of forms(leaf, form, n, masked, docs)."""
    # With so many words different at most, one of the segments (every (allowed + 1)-th word) is the same.
    parts = materialise(segment_table(forms, depth, similarity), "parts")
    first = parts.groupBy("segment").agg(F.max(F.struct("docs", "form")).alias("best")).select("segment", "best")
    pairs = materialise(parts.join(first, "segment").select("leaf", "form", "best.docs", F.col("best.form").alias("head")).distinct(), "pairs")
    free(parts)
    # Words are fetched for pairs of two forms only; most forms lead their own segments.
    lines = forms.select("leaf", "form", "masked")
    heads = forms.select("leaf", F.col("form").alias("head"), F.col("masked").alias("other"))
    words = F.split("masked", " ")
    same = F.aggregate(F.zip_with(words, F.split("other", " "), lambda x, y: x == y), F.lit(0), lambda k, x: k + x.cast("int"))
    agree = pairs.where("form <> head").join(lines, ["leaf", "form"]).join(heads, ["leaf", "head"]).where(same >= F.size(words) - F.floor((1 - similarity) * F.size(words) + F.lit(1e-9)))
    agree = agree.select("leaf", "form", "docs", "head").union(pairs.where("form = head").select("leaf", "form", "docs", "head"))
    chosen = materialise(agree.groupBy("leaf", "form").agg(F.max(F.struct("docs", "head")).alias("best")).select("leaf", "form", F.col("best.head").alias("head")), "chosen")
    free(pairs)
    # A template may itself have been put under a more common one.
    above = chosen.select("leaf", F.col("form").alias("head"), F.col("head").alias("top"))
    return forms.select("leaf", "form").join(chosen, ["leaf", "form"], "left").join(above, ["leaf", "head"], "left").select("leaf", "form", F.coalesce("top", "head", "form").alias("template"))


def recurring_lines(texts: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, most_share: float = MOST_SHARE) -> DataFrame:
    """(key, drop): places of the lines to drop in texts(key, text); equal texts share a key and count once."""
    lines = materialise(line_table(texts, depth), "lines")
    counted = materialise(lines.select("leaf", "form", "n", "key").distinct().groupBy("leaf", "form", "n").agg(F.count("*").alias("docs")), "counted")
    # Texts with two forms of a leaf count twice here, so no leaf with enough texts is missed.
    busy = materialise(counted.groupBy("leaf").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"), "busy")
    # At most BUCKETS rows are broadcast, at any size; they pick out nearly all lines of busy leaves before the exact join.
    bucket = F.pmod("leaf", F.lit(BUCKETS)).alias("bucket")
    some = lines.withColumn("bucket", bucket).join(F.broadcast(busy.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    held = some.join(busy, "leaf", "left_semi")
    forms = held.groupBy("leaf", "form").agg(F.any_value("masked").alias("masked")).join(counted, ["leaf", "form"])
    named = templates(materialise(forms, "forms"), depth, similarity)
    seen = materialise(held.select("key", "total", "pos", "n", "leaf", "form").distinct().join(named, ["leaf", "form"]).select("key", "total", "pos", "n", "template"), "seen")
    common = seen.select("template", "key").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("template")
    common = materialise(seen.join(common, "template", "left_semi"), "common")
    free(lines, counted, busy, seen)
    other = common.groupBy("key", "total").agg(F.sum("n").alias("words")).where(F.col("words") <= F.lit(most_share) * F.col("total")).select("key")
    support = common.select("template", "key").distinct().join(other, "key", "left_semi").groupBy("template").agg(F.count("*").alias("docs"))
    recurring = support.where(F.col("docs") >= min_docs).select("template")
    return common.join(recurring, "template", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("drop"))


def _judged(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame, str]:
    """The documents with a text and the places to drop, those without, and the name of the column of places."""
    key, drop = fresh(docs, "line_key"), fresh(docs, "line_drop")
    texts = docs.where("text IS NOT NULL").withColumn(key, F.xxhash64("text"))
    found = recurring_lines(texts.select(F.col(key).alias("key"), "text"), **how).select(F.col("key").alias(key), F.col("drop").alias(drop))
    # The places to drop grow with the corpus, so they are never broadcast.
    return texts.join(found.hint("merge"), key, "left").drop(key), docs.where("text IS NULL"), drop


def kept_text(text: bytes, drop: list[int] | None) -> bytes:
    if not drop:
        return text
    gone = set(drop)
    return b"\n".join(line for pos, line in enumerate(text.split(b"\n")) if pos not in gone)


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """The documents with all their columns, without recurring lines."""
    judged, rest, drop = _judged(docs, **how)
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [kept_text(t, d) for t, d in zip(as_bytes(columns[at]), columns[-1].to_pylist(), strict=True)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns[:-1], names)

    ordered = judged.select(*(F.col(f"`{c}`") for c in docs.columns), drop)
    return ordered.mapInArrow(cut, docs.schema).union(rest)


def digest(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_dropped, kept_text."""
    judged, rest, drop = _judged(docs.select("doc_id", "text"), **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = as_bytes(batch.column(1)), batch.column(2).to_pylist()
            lines = [sum(1 for line in t.split(b"\n") if line.strip(b" \t\x0b\f\r")) for t in texts]
            kept = pa.array([kept_text(t, d) for t, d in zip(texts, drops, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lines, pa.int64()), pa.array([len(d or ()) for d in drops], pa.int64()), kept], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    none = F.lit(0).cast("long")
    done = judged.select("doc_id", "text", drop).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")
    return done.union(rest.select(F.col("doc_id").cast("long"), none, none, F.col("text")))
