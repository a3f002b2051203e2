"""Operator 8, suffix-array dedup: remove bytes of long strings that also start elsewhere.

A logarithmic family of sparse suffix arrays over batches of documents. Suffixes are
sampled at anchors: of all ``GRAM``-byte strings inside one ``length``-byte string the
one of least hash is its anchor, so equal long strings share their anchor at the same
place, and every string has one. A batch's suffix array holds its sampled suffixes,
sorted by the fingerprint of their first ``GRAM`` bytes (an order that all batches
share; the lexicographic one is not needed, as only matches count). Every new batch
is merge-scanned against itself and all existing levels for suffixes that begin
alike, becomes a level, and levels of one size merge. ``SuffixIndex`` is that family;
its levels are written tables, and batches, scans and merges are distributed.

Suffixes that met another go on with what surrounds them, and matches are decided on
bytes: in each group of one anchor, strings of ``length`` bytes with one fingerprint are
compared byte by byte. Places of an anchor with the same surroundings are one entry
with a count. An anchor in very many different surroundings is dealt out by
fingerprints of its strings (two of 64 bits), so no key grows without bound. Spans
return to their documents and are joined there.

Texts are UTF-8 bytes, null as empty; matches never cross documents. A repeated
row is another place of its text, so both lose what they share. An empty table gives
no rows. Texts of any length are read whole, ``CHUNK`` bytes of them at a time. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.store import free, materialise
from mailweave.llm.text import BLOCK, U64, as_bytes, mix, powers, prefix

LENGTH, GRAM = 400, 64
#: Strings of a text that are looked at together; an anchor's place must fit in 24 bits.
CHUNK = 1 << 23
#: Keys that the places of one anchor are dealt over in joins.
SALTS = 16
#: Entries of an anchor that one task compares; beyond, its strings are dealt out by fingerprint.
MOST_ENTRIES = 2048
#: Batches that a corpus is added in.
BATCHES = 4


def byte_windows(raw: bytes, k: int) -> np.ndarray:
    """A fingerprint of every k-byte string of ``raw``."""
    a = np.frombuffer(raw, np.uint8)
    out = []
    for i in range(0, max(len(a) - k + 1, 0), BLOCK):
        x = a[i : i + BLOCK + k - 1]
        p, down = prefix(x), powers(len(x) + 1)[1]
        n = len(x) - k + 1
        out.append(mix((p[k:] - p[:-k]) * down[:n]))
    return np.concatenate(out) if out else np.zeros(0, U64)


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of ``raw``: hash, and first and last start of the strings that it is the anchor of.

    Each string has one anchor, the leftmost of its grams with the least 40 bits of hash.
    """
    h = byte_windows(raw, gram)
    span = length - gram + 1
    out = []
    for i in range(0, len(h) - span + 1, CHUNK):
        own = h[i : i + CHUNK + span - 1]
        n = len(own)
        key = (own >> U64(24) << U64(24)) | np.arange(n, dtype=U64)
        full = np.concatenate((key, np.full(-n % span, ~U64(0)))).reshape(-1, span)
        left = np.minimum.accumulate(full, axis=1).ravel()
        right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[: n - span + 1], left[span - 1 : n])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.append(first[1:], len(least)) - 1
        out.append((own[(least[first] & U64((1 << 24) - 1)).astype(np.int64)], first + i, last + i))
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class SuffixIndex:
    """Levels of sampled suffixes, sorted by fingerprint; sizes grow geometrically."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def _sorted(suffixes: DataFrame, name: str) -> DataFrame:
        order = ["hash", "key", "first"]  # so that a frequent fingerprint is dealt over many tasks
        return materialise(suffixes.repartitionByRange(*order).sortWithinPartitions(*order), name)

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """Take in a batch's suffixes (hash, key, first, last); returns tables of the hashes that were met again."""
        own = self._sorted(batch, "suffixes")
        counted = own.groupBy("hash").agg(F.count("*").alias("n"))
        met = [counted.where("n > 1").select("hash")]
        met += [counted.select("hash").join(level.select("hash").distinct(), "hash") for _, level in self.levels]
        found = [materialise(m, "met") for m in met]
        self.levels.append((1, own))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            merged = self._sorted(a.union(b), "level")
            free(a, b)
            self.levels.append((n + m, merged))
        return found

    def suffixes(self) -> DataFrame:
        """All suffixes taken in."""
        return reduce(DataFrame.union, (level for _, level in self.levels))


def matches(keys: np.ndarray, entry: np.ndarray, start: np.ndarray, ctx: list[bytes], length: int) -> np.ndarray:
    """Which of the strings ctx[entry][start : start + length], known by their fingerprints, are found twice or more."""
    order = np.lexsort((start, entry, keys))
    same = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(keys), bool)
    a, b = order[:-1][same], order[1:][same]
    # Neighbours that go on together are compared once, as one longer string.
    by = np.lexsort((start[a], start[b] - start[a], entry[b], entry[a]))
    a, b = a[by], b[by]
    if not len(a):
        return hit
    go_on = (entry[a][1:] == entry[a][:-1]) & (entry[b][1:] == entry[b][:-1]) & (start[a][1:] == start[a][:-1] + 1) & (start[b][1:] == start[b][:-1] + 1)
    cut = np.flatnonzero(np.concatenate(([True], ~go_on)))
    good = np.zeros(len(a), bool)
    for i, j in zip(cut.tolist(), np.append(cut[1:], len(a)).tolist(), strict=True):
        x, y, s, t, n = ctx[entry[a[i]]], ctx[entry[b[i]]], int(start[a[i]]), int(start[b[i]]), j - i + length - 1
        if x[s : s + n] == y[t : t + n]:
            good[i:j] = True
    hit[a[good]] = hit[b[good]] = True
    if not good.all():  # fingerprints that lie: decide these by the strings themselves
        doubtful = np.flatnonzero(np.isin(keys, keys[a[~good]]))
        by_string: dict[bytes, list[int]] = {}
        for k in doubtful.tolist():
            by_string.setdefault(ctx[entry[k]][start[k] : start[k] + length], []).append(k)
        hit[doubtful] = False
        for places in by_string.values():
            hit[places] = len(places) > 1
    return hit


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by strings of ``length`` bytes that begin at the sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, spans) for the distinct texts(key, text, n); a text found n times repeats all of itself."""
    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                h, first, last = anchors(text, length, gram)
                if len(h):
                    yield pa.RecordBatch.from_pydict({"key": np.full(len(h), key), "first": first, "last": last, "hash": h.view(np.int64)})

    sampled = materialise(texts.select("key", "text").mapInArrow(list_anchors, "key long, first long, last long, hash long"), "anchors")
    index, met = SuffixIndex(), []
    for k in range(BATCHES):
        met += index.add(sampled.where(F.pmod("key", F.lit(BATCHES)) == k))
    free(sampled)
    found = index.suffixes()
    often = reduce(DataFrame.union, met).distinct()
    # A frequent anchor's places are dealt over SALTS keys; the other side has one row per anchor and salt.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    own = found.withColumn("salt", F.pmod(F.xxhash64("key", "first"), F.lit(SALTS)).cast("int"))
    again = own.join(often.select("hash", salts), ["hash", "salt"], "left_semi").drop("salt")
    # As many anchors at most as the key's text has places.
    places = again.groupBy("key").agg(F.collect_list(F.struct("first", "last", "hash")).alias("anchors"))
    wanted = texts.select("key", "text").join(places, "key")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, at in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for i in range(0, len(at), 4096):
                    own = at[i : i + 4096]
                    low = [a["first"] for a in own]
                    ctx = [text[a["first"] : a["last"] + length] for a in own]
                    yield pa.RecordBatch.from_pydict({"hash": [a["hash"] for a in own], "key": [key] * len(own), "low": low, "ctx": ctx})

    # An entry for each anchor and surroundings; its places are counted, and its first place stands for it.
    around = materialise(wanted.mapInArrow(surroundings, "hash long, key long, low long, ctx binary"), "around")
    entry = F.xxhash64("ctx", F.lit(3))
    entries = around.groupBy("hash", entry.alias("entry")).agg(F.count("*").alias("m"), F.any_value("ctx").alias("ctx"))

    def scan(group: pa.Table) -> pa.Table:
        """Compare the entries of one anchor; returns the repeated starts of each entry as spans."""
        names, m, ctx = group["entry"].to_numpy(), group["m"].to_numpy(), group["ctx"].to_pylist()
        prints = [byte_windows(c, length) for c in ctx]
        sizes = np.array([len(p) for p in prints])
        entry = np.repeat(np.arange(len(ctx)), sizes)
        start = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hit = matches(np.concatenate(prints), entry, start, ctx, length) | (m > 1)[entry]
        out, ends = [], np.concatenate(([0], np.cumsum(sizes)))
        for i in range(len(names)):
            out += [(group["hash"][0].as_py(), names[i], s, e) for s, e in spans_of(np.flatnonzero(hit[ends[i] : ends[i + 1]]), length)]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["hash", "entry", "s", "e"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, name, ctx in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                w = byte_windows(ctx, length).view(np.int64)
                other = byte_windows(bytes(255 - b for b in ctx), length).view(np.int64)
                yield pa.RecordBatch.from_pydict({"hash": np.full(len(w), h), "entry": np.full(len(w), name), "s": np.arange(len(w)), "window": w, "other": other})

    entries = materialise(entries, "entries")
    sized = entries.join(entries.groupBy("hash").agg(F.count("*").alias("__n")).where(F.col("__n") > MOST_ENTRIES), "hash", "left")
    few, many = sized.where("__n IS NULL").drop("__n"), sized.where("__n IS NOT NULL").drop("__n")
    shape = "hash long, entry long, s long, e long"
    repeated = few.groupBy("hash").applyInArrow(scan, shape)
    spread = many.select("hash", "entry", "ctx").mapInArrow(windows, "hash long, entry long, s long, window long, other long")
    twice = spread.groupBy("window", "other").agg(F.count("*").alias("n")).where("n > 1").select("window", "other")
    repeated = repeated.union(spread.join(twice, ["window", "other"], "left_semi").select("hash", "entry", "s", (F.col("s") + length).alias("e")))
    copied = many.where("m > 1").select("hash", "entry", F.lit(0).cast("long").alias("s"), F.octet_length("ctx").cast("long").alias("e")).where(F.col("e") >= length)
    repeated = repeated.union(copied)
    slim = around.select("hash", entry.alias("entry"), "key", "low", F.pmod(F.xxhash64("key", "low"), F.lit(SALTS)).cast("int").alias("salt"))
    spans = slim.join(repeated.select("*", salts), ["hash", "entry", "salt"]).select("key", (F.col("low") + F.col("s")).alias("s"), (F.col("low") + F.col("e")).alias("e"))
    done = materialise(spans.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    free(around, entries, *(level for _, level in index.levels))
    return done


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text and removed.

    kept_text is what is left as text; half a character at an edge becomes U+FFFD there. removed says whether bytes went.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = plain.withColumn("key", F.xxhash64("text"))
    # Equal texts are one text; where it is long enough, all of each copy is repeated.
    texts = materialise(keyed.groupBy("key").agg(F.any_value("text").alias("text"), F.count("*").alias("n"), F.min("doc_id").alias("first")), "texts")
    spans = repeated_spans(texts.where(F.octet_length("text") >= length), length, gram)
    judged = texts.join(spans, "key", "left").select("key", "text", "n", F.col("spans.s").alias("s"), F.col("spans.e").alias("e"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, n, s, e in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if n > 1 and len(text) >= length:
                    s, e = [0], [len(text)]
                gone = np.zeros(len(text) + 2, np.int32)
                np.add.at(gone, np.array(s or [], np.int64) + 1, 1)
                np.add.at(gone, np.array(e or [], np.int64) + 1, -1)
                covered = np.cumsum(gone)[:-1] > 0
                edges = np.diff(np.append(covered, False).astype(np.int8))
                kept = np.frombuffer(text, np.uint8)[~covered[1:]].tobytes()
                rows.append((key, len(text), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), bool(covered.any())))
            names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "removed"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, removed boolean"
    done = judged.mapInArrow(cut, schema)
    return keyed.select("doc_id", "key").join(done, "key").drop("key")
