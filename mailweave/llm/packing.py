"""Operator 10, best-fit packing into sequences of at most ``capacity`` tokens.

Bulk-synchronous best fit. A round takes the documents of one band of lengths
(each band reaches down to half of the one before, longest first) and all gaps
that could hold one of them. Both are range-sorted by size and dealt, by their
share of all rows, over parts, so that a part has documents and gaps of the same
rank; a common length is split by a hash of the row. Every part sweeps its
documents, longest first, over its gaps for the successor: the smallest gap that
holds one. Where several want one gap, rank decides and the next in rank sweeps
on; gaps shrink by what they took and are swept again. What finds no gap opens
new sequences in its part. Then gaps are updated and the next round begins.

Inside a part, documents of one length and gaps of one size are interchangeable,
so its sweep moves runs of ranks and costs a step per run, not per document. The
driver sees counts by size alone: at most ``capacity`` rows for documents and for
gaps. Each round is written, so a lost executor costs one round at most.

Documents longer than the capacity are cut from the end into full pieces; the
first piece may be shorter. A null or empty text is its end id alone. Repeated
rows are packed each on its own. Other columns are dropped.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.encoding import binary_rows, encoder
from mailweave.llm.store import materialise
from mailweave.llm.text import as_bytes, text_slices

#: Rows that one part of a round aims at.
PART_ROWS = 1 << 15


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut them: one row per piece, with its ids on request."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i, j in text_slices(texts, 4 << 20):
                ids, sizes = enc.encode(texts[i:j], end_id)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(i, j), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = np.repeat(sizes - (n - 1) * capacity, n)
                start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first)
                at = np.repeat(np.cumsum(sizes) - sizes, n) + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(binary_rows(ids, length))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], capacity: int, given: dict[int, int] | None = None):
    """Sweep the documents of a histogram of lengths, longest first, over gaps given by a histogram of sizes.

    Returns slots (length, from rank, to rank, first gap, offset), each saying that documents of that length and
    those ranks go one each to consecutive gaps at that offset; the gaps left as (size, first gap, count); and the
    number of gaps. Gaps are numbered by size, the given ones first, then the new sequences.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> runs (first gap, count)
    sizes: list[int] = []  # sizes with a gap, sorted
    opened = 0

    def give(size: int, run: tuple[int, int]) -> None:
        if size:
            if not gaps[size]:
                bisect.insort(sizes, size)
            gaps[size].append(run)

    for size in sorted(given or {}):
        give(size, (opened, given[size]))
        opened += given[size]
    for length in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-left // (capacity // length))
                size, run = capacity, (opened, n)
                opened += n
            else:
                size = sizes[at]
                run = gaps[size].pop()
                if not gaps[size]:
                    sizes.pop(at)
            first, n = run
            fit = size // length
            full, odd = divmod(left, fit)
            if full >= n:
                full, odd = n, 0
            for j in range(fit):
                if full:
                    slots.append((length, rank, rank + full, first, capacity - size + j * length))
                    rank += full
            if full:
                give(size - fit * length, (first, full))
            for j in range(odd):
                slots.append((length, rank, rank + 1, first + full, capacity - size + j * length))
                rank += 1
            if odd:
                give(size - odd * length, (first + full, 1))
            rest = n - full - bool(odd)
            if rest:
                give(size, (first + full + bool(odd), rest))
            left = counts[length] - rank
    return slots, [(size, *run) for size, runs in gaps.items() for run in runs], opened


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of first[0] .. first[0] + n[0] - 1, then those of the next run, and so on."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def sweep(capacity: int, number: int) -> Callable[[pa.Table], pa.Table]:
    """What a part of a round does: it returns places of its documents, and its gaps as they are then."""
    return lambda group: _sweep(group, capacity, number)


def _sweep(group: pa.Table, capacity: int, number: int) -> pa.Table:
    kind, size, row = (group[c].to_numpy() for c in ("kind", "size", "id"))
    docs, gaps = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    docs = docs[np.lexsort((row[docs], size[docs]))]
    gaps = gaps[np.lexsort((row[gaps], size[gaps]))]
    lengths, begin, counts = np.unique(size[docs], return_index=True, return_counts=True)
    given = dict(zip(*(x.tolist() for x in np.unique(size[gaps], return_counts=True)), strict=True))
    slots, left, opened = best_fit(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), capacity, given)
    base = (number << 56) + (int(group["part"][0].as_py()) << 28)
    names = np.concatenate((row[gaps], base + np.arange(opened - len(gaps))))
    slot = np.array(slots, np.int64).reshape(-1, 5)
    n = slot[:, 2] - slot[:, 1]
    which = docs[_ranges(begin[np.searchsorted(lengths, slot[:, 0])] + slot[:, 1], n)]
    rest = np.array(left, np.int64).reshape(-1, 3)
    open_ = names[_ranges(rest[:, 1], rest[:, 2])]
    none = np.zeros(len(open_), np.int64)
    return pa.table({
        "kind": np.concatenate((np.zeros(len(which), np.int32), np.ones(len(open_), np.int32))),
        "id": np.concatenate((row[which], open_)),
        "size": np.concatenate((size[which], np.repeat(rest[:, 0], rest[:, 2]))),
        "sequence_id": np.concatenate((names[_ranges(slot[:, 3], n)], none)),
        "offset": np.concatenate((np.repeat(slot[:, 4], n), none)),
    })


def dealt(rows: DataFrame, counts: dict[int, int], parts: int) -> DataFrame:
    """rows(kind, size, id) with the part that each one's share of all rows, ordered by size, falls in."""
    if parts == 1:
        return rows.withColumn("part", F.lit(0))
    total, before, spec = sum(counts.values()), 0, []
    for size in sorted(counts):
        spec.append((size, before / total, counts[size] / total))
        before += counts[size]
    # At most ``capacity`` rows.
    table = F.broadcast(rows.sparkSession.createDataFrame(spec, "size long, low double, width double"))
    luck = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    part = F.least(F.floor((F.col("low") + luck * F.col("width")) * parts), F.lit(parts - 1)).cast("int")
    return rows.join(table, "size").select("kind", "size", "id", part.alias("part"))


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces, each with a number of its own in ``row``."""
    lengths = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    found: list[tuple[int, DataFrame]] = []  # the lower end of each round's band, and what it wrote
    high, number = capacity, 0
    while high:
        low, number = high // 2, number + 1
        own = {s: n for s, n in lengths.items() if low < s <= high}
        last, high = high, low
        if not own:
            continue
        docs = cut.where(F.col("length").between(low + 1, last)).select(F.lit(0).alias("kind"), F.col("length").alias("size"), F.col("row").alias("id"))
        taken: dict[int, int] = {}
        gaps = None
        for k, (_, table) in enumerate(found):
            # Larger gaps of older rounds have gone to the rounds between.
            top = capacity if k == len(found) - 1 else found[-1][0]
            some = table.where(F.col("kind") == 1).where(F.col("size").between(low + 1, top)).select("kind", "size", "id")
            gaps = some if gaps is None else gaps.union(some)
        if gaps is not None:
            taken = {r["size"]: r["count"] for r in gaps.groupBy("size").count().collect()}  # at most ``capacity`` rows
        parts = max(1, -(-max(sum(own.values()), sum(taken.values())) // PART_ROWS))
        rows = dealt(docs, own, parts)
        if taken:
            rows = rows.unionByName(dealt(gaps, taken, parts))
        round_ = rows.groupBy("part").applyInArrow(sweep(capacity, number), "kind int, id long, size long, sequence_id long, offset long")
        found.append((low, materialise(round_, "round")))
    if not found:
        return cut.drop("row").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    places = None
    for _, table in found:
        own_places = table.where(F.col("kind") == 0).select(F.col("id").alias("row"), "sequence_id", "offset")
        places = own_places if places is None else places.union(own_places)
    # Places grow with the corpus, so they are never broadcast.
    return cut.join(places.hint("merge"), "row").drop("row")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    cut = materialise(pieces(docs, tokenizer, end_id, capacity, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return place(cut, capacity)
