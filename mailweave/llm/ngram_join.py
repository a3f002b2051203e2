"""Operator 5, n-gram Jaccard join: MinHash banding, then pairs verified on full n-gram sets.

A document's set holds its distinct windows of ``k`` words (all its words as one
window if it has fewer). Documents with one set are one node, so copies meet
once and count by their number. Band and row counts are the cheapest that find
a pair at the threshold with probability ``recall``. Nodes are shuffled on band
hashes, without their sets; nodes that share buckets, directly or by others, are a
cluster. Full sets go to the task of their cluster, once, and there each pair with
a common band is verified once. A cluster of more than ``TILE`` nodes is compared in
tiles, either of the cluster or of its buckets, whichever sends fewer sets; in
buckets a pair is verified where its first common band is. Tiles send link counts
and a spanning forest, never pairs. Hot keys: copies are one node, aggregates
combine before they shuffle, and a large cluster or bucket is dealt over its tiles.

A null or empty text has no words and links with nothing. Repeated rows each
get a row and count as links of one another. A null doc_id is kept only where no
row of its class has an id. Very long texts are read whole; a worker holds the
windows of one text at least. Other columns are ignored by ``near_copies`` and kept
by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.components import components
from mailweave.llm.store import free, materialise
from mailweave.llm.tables import fresh, sieved
from mailweave.llm.text import U64, as_bytes, give_back, mix, text_slices, window_hashes, words_of
from mailweave.llm.vector_dedup import TALLY, tally

#: Nodes of a tile, and nodes of small clusters that share a task's group.
TILE, GROUP = 1024, 512


def choose_bands(threshold: float, recall: float, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose recall at the threshold is reached within most_hashes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no banding reaches that recall")


def ngram_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word windows of each text."""
    h, at = words_of(texts)
    out = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        out.append(np.unique(window_hashes(h[s:e], min(k, max(int(e - s), 1)))))
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per set (none empty) and band."""
    rng = np.random.default_rng(20)
    a, b = rng.integers(1, 1 << 63, bands * rows, dtype=U64) | U64(1), rng.integers(0, 1 << 63, bands * rows, dtype=U64)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    every = np.concatenate(sets)
    out = np.zeros((len(sets), bands), U64)
    x, y = np.empty_like(every), np.empty_like(every)
    for i in range(bands * rows):
        np.multiply(every, a[i], out=x)
        x += b[i]
        np.right_shift(x, U64(32), out=y)
        x ^= y
        x *= a[-1 - i]
        out[:, i // rows] = mix(out[:, i // rows] + np.minimum.reduceat(x, at))
    return out


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, bands, grams): the hash of each document's set, its band hashes and 48 bits of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i, j in text_slices(texts, 1 << 18):
                sets = ngram_sets(texts[i:j], k)
                full = [n for n, s in enumerate(sets) if len(s)]
                node = [None if not len(s) else int(mix(np.array([mix(s).sum(), len(s)], U64))[[0]].view(np.int64)[0]) for s in sets]
                hashes = [None] * len(sets)
                if full:
                    for n, h in zip(full, band_hashes([sets[n] for n in full], bands, rows), strict=True):
                        hashes[n] = h.astype("<u8").tobytes()
                grams = [(s >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets]
                columns = [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(node, pa.int64()), pa.array(hashes, pa.binary()), pa.array(grams, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "bands", "grams"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, bands binary, grams binary")


def read_grams(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def similar_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (a[i], b[i]), sorted by a, have Jaccard similarity at least ``threshold``."""
    sizes = np.array([len(s) for s in sets])
    good = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    used, of = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(len(used), np.int32)
    pairs = np.flatnonzero(good)
    first = np.flatnonzero(np.diff(a[pairs], prepend=-1))
    for s, e in zip(first, np.append(first[1:], len(pairs)), strict=True):
        x = a[pairs[s]]
        own = of[at[x] : at[x + 1]]
        mark[own] = 1
        for i in range(s, e, 256):
            y = b[pairs[i : min(e, i + 256)]]
            ends = np.cumsum(sizes[y])
            others = np.repeat(at[y] - ends + sizes[y], sizes[y]) + np.arange(ends[-1])
            common = np.add.reduceat(mark[of[others]], ends - sizes[y])
            good[pairs[i : min(e, i + 256)]] = common >= threshold * (sizes[x] + sizes[y] - common) - 1e-9
        mark[own] = 0
    return good


def candidates(unit: np.ndarray, side: np.ndarray, band: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of a group to verify, sorted by a: of one unit, from sides ``lo`` and ``hi``, with a common band.

    In a cluster (band -1) any band counts; in a bucket, the pair must not meet in an earlier band.
    """
    order = np.argsort(unit, kind="stable")
    starts = np.flatnonzero(np.diff(unit[order], prepend=unit[order[0]] - 1 if len(order) else 0))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for s, e in zip(starts, np.append(starts[1:], len(order)), strict=True):
        rows = order[s:e]
        k = int(band[rows[0]])
        left, right = (rows[side[rows] == x] for x in (lo, hi)) if lo < hi else (rows, rows)
        for n, i in enumerate(left):
            other = right if lo < hi else rows[n + 1 :]
            same = h[other] == h[i]
            keep = same.any(axis=1) if k < 0 else ~same[:, :k].any(axis=1)
            if keep.any():
                found.append((np.full(int(keep.sum()), i), other[keep]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def cluster_links(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect what members(node, rep) connect: one a node, to the least of its buckets' first nodes, and
    those between first nodes, which the nodes of a large group of near copies have in common."""
    reps = members.groupBy("node").agg(F.collect_set("rep").alias("reps")).select("node", F.array_min("reps").alias("least"), "reps")
    between = reps.select(F.explode("reps").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    return reps.select(F.col("node").alias("a"), F.col("least").alias("b")).where("a <> b").union(between)


def units(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, unit, band, parts): the clusters or buckets in which each node is compared.

    members(node, key, band, rep) and buckets(key, n, rep) are those of two nodes or more.
    """
    clusters = materialise(components(cluster_links(members)), "clusters")
    tiles = lambda n: F.ceil(n / F.lit(TILE)).cast("long")
    size = clusters.groupBy("component").agg(F.count("*").alias("m"))
    cost = buckets.join(clusters.hint("merge"), buckets.rep == clusters.node).groupBy("component").agg(F.sum(F.col("n") * tiles(F.col("n"))).alias("cost"))
    mode = size.join(cost.hint("merge"), "component").select("component", tiles(F.col("m")).alias("parts"), ((F.col("m") > TILE) & (F.col("cost") < F.col("m") * tiles(F.col("m")))).alias("split"))
    placed = materialise(clusters.join(mode.hint("merge"), "component").select("node", "component", "parts", "split"), "placed")
    whole = placed.where("NOT split").select("node", F.col("component").alias("unit"), F.lit(-1).alias("band"), "parts")
    single = members.join(placed.where("split").select("node"), "node", "left_semi").join(buckets.select("key", tiles(F.col("n")).alias("parts")), "key")
    return whole.union(single.select("node", F.col("key").alias("unit"), "band", "parts"))


def near_copies(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, n_links, class_id (smallest doc_id reachable by links), kept."""
    bands, rows = choose_bands(threshold, recall)
    full = materialise(sketches(docs, k, bands, rows), "sketches")
    wordy = full.where("node IS NOT NULL")
    nodes = materialise(wordy.groupBy("node").agg(F.count("*").alias("weight"), F.min("doc_id").alias("first"), F.any_value("bands").alias("bands")), "nodes")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8")
            band = np.tile(np.arange(bands, dtype=np.int32), n)
            yield pa.RecordBatch.from_pydict({"node": np.repeat(batch.column(0).to_numpy(), bands), "band": band, "key": mix(h + band.astype(U64)).view(np.int64)})

    light = nodes.select("node", "bands").mapInArrow(unfold, "node long, band int, key long")
    buckets = materialise(light.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("rep")).where("n > 1"), "buckets")
    # What grows is never broadcast: joins are shuffles at every size.
    members = materialise(sieved(light, buckets, "key").join(buckets.select("key", "rep").hint("merge"), "key"), "members")
    where = materialise(units(members, buckets), "units")
    # Most sets belong to nodes that share no bucket; they are left out before the shuffle.
    sets = sieved(wordy, members, "node").join(members.select("node").distinct().hint("merge"), "node").groupBy("node").agg(F.any_value("grams").alias("grams"))
    sets = materialise(sets.join(nodes.select("node", "weight", "bands").hint("merge"), "node"), "sets")
    slim = materialise(full.select("doc_id", "node"), "documents")
    free(full)
    groups = where.where("parts = 1").count() // GROUP + 1
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))
    tiles = where.withColumn("part", part).withColumn("other", other)
    # Small units share a group; a tile of a large one is a group of its own.
    group = F.when(F.col("parts") > 1, F.col("unit")).otherwise(F.pmod(F.xxhash64("unit"), F.lit(groups)))
    tiles = tiles.select("node", "unit", "band", "part", (F.col("parts") > 1).alias("tiled"), group.alias("cell"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def compare(group: pa.Table) -> pa.Table:
        node = group["node"].to_numpy()
        h = np.frombuffer(b"".join(group["bands"].to_pylist()), "<u8").reshape(len(node), bands)
        a, b = candidates(group["unit"].to_numpy(), group["part"].to_numpy(), group["band"].to_numpy(), h, group["lo"][0].as_py(), group["hi"][0].as_py())
        if len(a):
            good = similar_pairs([read_grams(x) for x in group["grams"].to_pylist()], a, b, threshold)
            a, b = a[good], b[good]
        return pa.Table.from_batches([tally(node, group["weight"].to_numpy().astype(np.float64), a, b)])

    tallies = materialise(tiles.join(sets.hint("merge"), "node").groupBy("tiled", "cell", "lo", "hi").applyInArrow(compare, TALLY), "tallies")
    free(members, buckets, where, sets)
    counted = tallies.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(tallies.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    about = nodes.select("node", "weight", "first").join(counted.hint("merge"), "node", "left").join(grouped.hint("merge"), "node", "left")
    about = about.select("node", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    # Only members of classes of two nodes or more meet in the aggregate.
    smallest = about.join(grouped.select("component").distinct().hint("merge"), "component", "left_semi").groupBy("component").agg(F.min("first").alias("class_id"))
    about = about.join(smallest.hint("merge"), "component", "left").select("node", "n_links", F.coalesce("class_id", "first").alias("class_id"))
    about = materialise(about, "about")
    free(nodes, tallies)
    alone = slim.where("node IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    placed = slim.where("node IS NOT NULL").join(about.hint("merge"), "node")
    return placed.select("doc_id", "n_links", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")).union(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9999) -> DataFrame:
    """The documents with all their columns, one of each class: that of least doc_id, then text hash."""
    row = fresh(docs, "row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.col(row).alias("r"))
    classes = near_copies(rows.select(F.col(row).alias("doc_id"), "text"), threshold, k, recall).select(F.col("doc_id").alias("r"), "class_id")
    stay = rows.select(first.alias("f")).join(classes, F.col("f.r") == classes.r).groupBy("class_id").agg(F.min("f").alias("f")).select(F.col("f.r").alias(row))
    return rows.join(stay.hint("merge"), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
