"""Distributed interpolated modified Kneser-Ney trigram models, one a language, counted over all of their documents.

Every language has two models, each of one half (fold 0 or 1) of its documents. Texts are
read into written blocks of one language. A block sends its distinct n-grams as sorted lists of
46-bit hashes, to partitions of the hash space, which add them up. One block that holds
an n-gram, its owner, is told its total and sends what follows from it to the next lower
order: that one more word precedes the shorter n-gram (single words count the distinct
pairs that end in them; at a text's start counts are plain), and what its context is followed by.
So each order is added up once, over lists that hold an n-gram once a block, and no model is
gathered anywhere: blocks of texts that are to be scored ask the partitions in the same way.
Only discounts, a row for each language, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.store import free, materialise
from mailweave.llm.text import U64, as_bytes, give_back, join_texts, mix, pack_arrays, ranked, small, text_slices, unpack_arrays, word_keys

BEGIN = U64(0x5851F42D4C957F2D)
#: Bytes of text per block, and per partition of the hash space.
BLOCK_BYTES, PART_BYTES = 4 << 20, 8 << 20
FOLDS, BITS = 2, 46
#: Rows that are dealt: lists of a block's n-grams of ``kind`` + 1 words, replies to them, parts of the model (block -1) and blocks (kind -1).
ROW = "kind int, part int, block long, lang string, blob binary"
#: Per fold: distinct n-grams found once to four times, the sum of all counts, and distinct n-grams; told beside a row of the model.
_SUMS = [f"s{f}{i}" for f in range(FOLDS) for i in range(6)]


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair (a, b) of hashes."""
    return mix(a * U64(0x9E3779B97F4A7C15) + b)


def text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def lowered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for i, j in text_slices(texts, 1 << 18):
        buf, at = join_texts(texts[i:j])
        h, s, _ = word_keys(buf.lower())
        hashes.append(h)
        counts.append(np.diff(np.searchsorted(s, at)))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more (index 0 is 0), of how many n-grams are found 1 to 4 times."""
    if not n[0]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    found = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))])


class Grams:
    """The n-grams of some texts of one language; the last single word and pair stand for a text's start."""

    def __init__(self, lang: str, texts: list[bytes]):
        h, self.at = lowered_words(texts)
        seed = U64(text_key(lang.encode()))
        begin = mix(np.array([BEGIN ^ seed]))
        w = mix(h ^ seed)
        self.n = n = len(w)
        first = np.zeros(n, bool)
        first[self.at[:-1][self.at[:-1] < self.at[1:]]] = True
        #: Where a token's context of one word, or of two, ends.
        self.before = np.append(np.where(first, n, np.arange(n) - 1), n)
        w = np.concatenate((w, begin))
        pair = chain(w[self.before], w)
        triple = chain(pair[self.before], w)[:n]
        self.codes = [x >> U64(64 - BITS) for x in (w, pair, triple)]

    def keys(self, kind: int) -> np.ndarray:
        """The sorted distinct n-grams."""
        x = np.sort(self.codes[kind])
        return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x

    def distinct(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct n-grams, and the place of each token's."""
        x = self.codes[kind]
        order = ranked(x, BITS)
        x = x[order]
        new = np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)
        place = np.empty(len(x), np.int64)
        place[order] = np.cumsum(new) - 1
        return x[new], place


def raised(own: Grams, kind: int, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """What n-grams with the given totals (0 where another block owns them) add to those of the next lower order.

    These are, each for all folds: how many n-grams end in it, how often it is followed, and by how many n-grams found once, twice, and more often.
    """
    found, place = own.distinct(kind)
    at = np.empty(len(found), np.int64)
    at[place] = np.arange(len(place))  # any token that ends in it
    keys, of = own.distinct(kind - 1)
    event, context, begins = of[at], of[own.before[at]], own.before[at] == own.n
    precedes, follows = [], []
    for c in counts:
        some, many = np.flatnonzero(c), np.flatnonzero(c > 2)
        n = np.bincount(event[some], minlength=len(keys))
        if kind == 2:
            plain = np.flatnonzero(begins & (c > 1))
            n += np.bincount(event[plain], c[plain] - 1.0, len(keys)).astype(np.int64)
        precedes.append(n)
        by = np.bincount(context[some] * 3 + np.minimum(c[some], 3).astype(np.int64) - 1, minlength=3 * len(keys)).reshape(-1, 3)
        total = by[:, 0] + 2 * by[:, 1] + np.bincount(context[many], c[many], len(keys)).astype(np.int64)
        follows.append((total, *by.T))
    return keys, precedes + [x for columns in zip(*follows, strict=True) for x in columns]


def blocks_of(rows: DataFrame, texts: str, langs: str, some: set[str] | None = None) -> DataFrame:
    """The rows, with all their columns, in written blocks of one language; those of other languages than ``some`` have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lang = [x if some is None or x in some else None for x in batch.column(langs).to_pylist()]
            groups: dict[str | None, list[int]] = {}
            for i, x in enumerate(lang):
                groups.setdefault(x, []).append(i)
            size = pc.binary_length(batch.column(texts).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
            for x, places in groups.items():
                cut = np.cumsum(size[places] + 1) // BLOCK_BYTES
                for part in np.split(np.array(places), np.flatnonzero(np.diff(cut)) + 1):
                    sink = pa.BufferOutputStream()
                    held = batch.take(pa.array(part))
                    # Compressed here, texts are small in shuffles too.
                    with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                        stream.write_batch(held)
                    columns = {"kind": [-1], "part": [0], "block": [number], "lang": [x], "blob": [sink.getvalue().to_pybytes()]}
                    yield pa.RecordBatch.from_pydict(columns, pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("lang", pa.string()), ("blob", pa.binary())]))
                    number += 1
        give_back()

    return materialise(rows.mapInArrow(run, ROW), "blocks", "uncompressed")


def opened(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_next_batch()


def gaps(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Differences of sorted keys of a part, the first from its begin."""
    return small(np.diff(keys, prepend=U64((part << BITS) // parts)))


def keys_of(gaps: np.ndarray, part: int, parts: int) -> np.ndarray:
    return np.cumsum(gaps, dtype=U64) + U64((part << BITS) // parts)


def dealt(kind: int, parts: int, block: int, lang: str, keys: np.ndarray, counts: list[np.ndarray]) -> dict:
    """The lists of a block, as columns of rows."""
    cuts = np.searchsorted(keys, np.array([(k << BITS) // parts for k in range(parts)] + [1 << BITS], U64)).tolist()
    lists = [(k, s, e) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > s]
    blobs = [pack_arrays(gaps(keys[s:e], k, parts), *(small(c[s:e]) for c in counts)) for k, s, e in lists]
    return {"kind": [kind] * len(lists), "part": [k for k, _, _ in lists], "block": [block] * len(lists), "lang": [lang] * len(lists), "blob": blobs}


_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("lang", pa.string()), ("blob", pa.binary())])


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.RecordBatch]]:
    """Blocks one at a time: a batch may hold dozens, and only one is unpacked beside it."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row["block"], row["lang"], opened(row["blob"])
    give_back()


def with_replies(blocks: DataFrame, replies: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(block, lang, rows, replies)`` for each block; replies has for each kind the arrays told for its distinct n-grams."""

    def judge(group: pa.Table) -> pa.Table:
        kinds, parts, blobs = group["kind"].to_pylist(), group["part"].to_pylist(), group["blob"]
        own = kinds.index(-1)
        found: dict[int, list[np.ndarray]] = {}
        for kind in set(kinds) - {-1}:
            lists = [unpack_arrays(blobs[i].as_py()) for _, i in sorted((parts[i], i) for i, k in enumerate(kinds) if k == kind)]
            found[kind] = [np.concatenate(x) for x in zip(*lists, strict=True)]
        out = run(group["block"][own].as_py(), group["lang"][own].as_py(), opened(blobs[own].as_py()), found)
        give_back(1)
        return out

    return blocks.union(replies).groupBy("block").applyInArrow(judge, schema)


def _unpacked(blobs: list[bytes], part: int, parts: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ends of lists, and their keys and counts in one array each."""
    lists = [unpack_arrays(x) for x in blobs]
    ends = np.cumsum([0, *(len(x[0]) for x in lists)])
    keys = np.concatenate([keys_of(x[0], part, parts) for x in lists])
    return ends, keys, [np.concatenate([x[i] for x in lists]).astype(np.uint32) for i in range(1, len(lists[0]))]


def added_up(lists: DataFrame, parts: int, name: str) -> DataFrame:
    """Written rows of the model (block -1), the sums of their languages (block -2), and replies that tell owners the totals of n-grams."""

    def run(group: pa.Table) -> pa.Table:
        kind, part = group["kind"][0].as_py(), group["part"][0].as_py()
        blocks = group["block"].to_pylist()
        group = group.take(pa.array(np.argsort(blocks, kind="stable")))
        ends, keys, counts = _unpacked(group["blob"].to_pylist(), part, parts)
        order = ranked(keys - U64((part << BITS) // parts), ((1 << BITS) // parts + 1).bit_length())
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        owner = order[starts]
        totals = []
        while counts:
            totals.append(np.add.reduceat(counts.pop(0)[order], starts, dtype=np.int64))
        langs = group["lang"].to_pylist()
        rows = {"kind": [kind], "part": [part], "block": [-1], "lang": [None], "blob": [pack_arrays(gaps(keys[starts], part, parts), *map(small, totals))]}
        sums = [[0] * len(_SUMS)]
        if kind:
            told = np.zeros((FOLDS, ends[-1]), np.int64)
            told[:, owner] = totals[:FOLDS]
            for i, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                for column, x in zip(rows.values(), (kind, part, group["block"][i].as_py(), langs[i], pack_arrays(*(small(t[s:e]) for t in told))), strict=True):
                    column.append(x)
                sums.append([0] * len(_SUMS))
        names = sorted(set(langs))
        place = np.searchsorted(ends, owner, side="right") - 1
        of = np.array([names.index(x) for x in langs])[place]
        for k, lang in enumerate(names):
            mine = [t[of == k] for t in totals[:FOLDS]]
            for column, x in zip(rows.values(), (kind, part, -2, lang, b""), strict=True):
                column.append(x)
            sums.append([int(x) for t in mine for x in (*((t == i).sum() for i in range(1, 5)), t.sum(), (t > 0).sum())])
        table = pa.table(rows, _SCHEMA)
        for i, column in enumerate(_SUMS):
            table = table.append_column(column, pa.array([x[i] for x in sums], pa.int64()))
        give_back(1)
        return table

    return materialise(lists.groupBy("kind", "part").applyInArrow(run, ROW + "".join(f", {c} long" for c in _SUMS)), name)


@dataclass
class Discounts:
    """The discounts of a language's model, from single words to three, and what an unknown word and all single words share."""

    by_kind: list[np.ndarray]
    total: int
    unknown: float

    @staticmethod
    def of(sums: dict[int, list[int]]) -> Discounts:
        by_kind = [discounts(sums.get(k, [0] * 6)[:4]) for k in range(3)]
        once, twice, _, _, total, kinds = sums.get(0, [0] * 6)
        held = by_kind[0] @ [0, once, twice, kinds - once - twice]
        return Discounts(by_kind, total, float(held / total / (kinds + 1)) if total else 0.0)


@dataclass
class Counts:
    """Counted n-grams as rows of written tables, by kind, and each language's discounts by fold."""

    tables: list[DataFrame]
    parts: list[int]
    languages: dict[str, list[Discounts]]


def count(blocks: DataFrame, size: int) -> Counts:
    """The models of blocks whose rows have a text and its fold; ``size`` bytes of text are counted or asked for at a time."""
    wide = max(8, size // PART_BYTES + 1)
    parts = [max(8, wide // 8), wide, wide]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lang, rows in each_block(batches):
            own = Grams(lang, as_bytes(rows.column("text")))
            fold = np.repeat(rows.column("fold").to_numpy(), np.diff(own.at))
            keys, of = own.distinct(2)
            yield pa.RecordBatch.from_pydict(dealt(2, parts[2], block, lang, keys, [np.bincount(of, fold == f, len(keys)).astype(np.int64) for f in range(FOLDS)]), _SCHEMA)

    def lower(kind: int) -> Callable:
        def run(block: int, lang: str, rows: pa.RecordBatch, replies: dict) -> pa.Table:
            own = Grams(lang, as_bytes(rows.column("text")))
            return pa.table(dealt(kind - 1, parts[kind - 1], block, lang, *raised(own, kind, replies[kind])), _SCHEMA)

        return run

    tables, sums, told = {}, {}, None
    for kind in (2, 1, 0):
        lists = blocks.mapInArrow(first, ROW) if kind == 2 else with_replies(blocks, told, lower(kind + 1), ROW)
        found = added_up(lists, parts[kind], "added")
        if told:
            free(told)
        tables[kind] = materialise(found.where("block = -1").select(*_SCHEMA.names), "counts", "uncompressed")
        for r in found.where("block = -2").groupBy("lang").agg(*(F.sum(c).alias(c) for c in _SUMS)).collect():
            for f in range(FOLDS):
                sums.setdefault(r["lang"], [{} for _ in range(FOLDS)])[f][kind] = [r[f"s{f}{i}"] for i in range(6)]
        # The replies alone stay while the next order is counted.
        told = materialise(found.where("block >= 0").select(*_SCHEMA.names), "told", "uncompressed") if kind else None
        free(found)
    return Counts([tables[k] for k in range(3)], parts, {lang: [Discounts.of(x) for x in folds] for lang, folds in sums.items()})


def log_probabilities(own: Grams, places: list[np.ndarray], found: dict[int, list[np.ndarray]], by: Discounts, fold: int) -> np.ndarray:
    """Natural log probability of each word by the model of one fold; ``found`` are the counts of the distinct n-grams."""
    p = np.zeros(own.n, np.float32)
    for kind, (d, place) in enumerate(zip(by.by_kind, places, strict=True)):
        c, d = found[kind][fold], d.astype(np.float32)
        rest = (c.astype(np.float32) - d[np.minimum(c, 3)])[place[: own.n]]
        if kind == 0:
            p = rest / np.float32(by.total) + np.float32(by.unknown)
            continue
        _, times, *followed = found[kind - 1][fold::FOLDS]
        # An n-gram is not found where its context is not: the estimate of the lower order is left as it is there.
        share = 1 / np.maximum(times, 1).astype(np.float32)
        gamma = np.where(times > 0, sum(x * y for x, y in zip(followed, d[1:], strict=True)) * share, np.float32(1))
        context = places[kind - 1][own.before[: own.n]]
        p = rest * share[context] + gamma[context] * p
    return np.log(p)


def log_perplexities(lang: str, texts: list[bytes], found: dict[int, list[np.ndarray]], by: list[Discounts]) -> np.ndarray:
    """Mean negative log probability per word of each text, by the model to which it is least known; NaN without words."""
    own = Grams(lang, texts)
    n, places = np.diff(own.at), [own.distinct(kind)[1] for kind in range(3)]
    out = np.full(len(texts), np.nan)
    for fold, d in enumerate(by):
        if own.n and d.total:
            total = np.concatenate(([0.0], np.cumsum(-log_probabilities(own, places, found, d, fold), dtype=np.float64)))
            out = np.fmax(out, np.where(n > 0, (total[own.at[1:]] - total[own.at[:-1]]) / np.maximum(n, 1), np.nan))
    return out


def asked(blocks: DataFrame, counts: Counts, kinds: tuple[int, ...]) -> DataFrame:
    """Written replies: for each list of a block's distinct n-grams their counts."""
    parts = counts.parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lang, rows in each_block(batches):
            own = Grams(lang, as_bytes(rows.column("text")))
            for kind in kinds:
                yield pa.RecordBatch.from_pydict(dealt(kind, parts[kind], block, lang, own.keys(kind), []), _SCHEMA)

    def reply(group: pa.Table) -> pa.Table:
        kind, part = group["kind"][0].as_py(), group["part"][0].as_py()
        blocks, blobs = group["block"].to_pylist(), group["blob"]
        keys, totals = np.zeros(0, U64), [np.zeros(0, np.uint8)] * (FOLDS if kind == 2 else 5 * FOLDS)
        if -1 in blocks:
            own, *totals = unpack_arrays(blobs[blocks.index(-1)].as_py())
            keys = keys_of(own, part, parts[kind])
        asked = group.filter(pa.array([x >= 0 for x in blocks]))
        out = []
        for raw in asked["blob"]:
            want = keys_of(unpack_arrays(raw.as_py())[0], part, parts[kind])
            at = np.searchsorted(keys, want)
            hit = np.flatnonzero(at < len(keys))
            hit = hit[keys[at[hit]] == want[hit]]
            at, told = at[hit], [np.zeros(len(want), t.dtype) for t in totals]
            for x, t in zip(told, totals, strict=True):
                x[hit] = t[at]
            out.append(pack_arrays(*map(small, told)))
        give_back(1)
        return asked.set_column(asked.column_names.index("blob"), "blob", pa.array(out, pa.binary()))

    rows = blocks.where("lang IS NOT NULL").mapInArrow(ask, ROW)
    for kind in kinds:
        rows = rows.union(counts.tables[kind])
    return materialise(rows.groupBy("kind", "part").applyInArrow(reply, ROW), "replies", "uncompressed")


def scored(blocks: DataFrame, counts: Counts, run: Callable, schema: str, name: str) -> DataFrame:
    """``run(lang, rows, log_perplexities)`` of each block, written."""
    languages = counts.languages

    def judge(block: int, lang: str | None, rows: pa.RecordBatch, found: dict) -> pa.Table:
        if lang is None or len(found) < 3:
            return run(lang, rows, np.full(rows.num_rows, np.nan))
        return run(lang, rows, log_perplexities(lang, as_bytes(rows.column("text")), found, languages[lang]))

    # One after the other, as the counts go through a shuffle beside the lists.
    replies = [asked(blocks, counts, kinds) for kinds in ((2,), (1, 0))]
    out = materialise(with_replies(blocks, replies[0].union(replies[1]), judge, schema), name)
    free(*replies)
    return out
