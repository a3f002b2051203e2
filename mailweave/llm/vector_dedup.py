"""Operator 9, embedding near-duplicates: int8 tile products with per-vector error bounds.

Distinct vectors are quantised to int8 once; every vector carries its scale, the
exact norm of what its code leaves out, and its components. They are dealt to
blocks of bounded size by a hash and written. Block by block, a block is broadcast
(``BLOCK_BYTES`` at most, whatever the corpus) and all blocks not before it are
scanned where they lie: tiles of codes are multiplied, and as the norms of what
two codes leave out bound the product's error, only pairs whose upper bound reaches
the threshold and whose lower bound does not exceed it are recomputed in double
precision. Nothing is shuffled for the comparison, and all executors share each
block's scan; the work is that of all tiles, so it grows with the square of the rows.

Tasks send link counts and a spanning forest of their links, never the links.
Equal vectors (all components the same) are compared once and counted with
their number. Null or zero vectors, and vectors with null or non-finite
components, link with nothing; vectors of different lengths do not link.
Repeated rows each get a row and count as links of one another. A null vec_id is
kept only where no row of its component has an id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.components import components, local_roots
from mailweave.llm.store import materialise, written

#: Bytes of a block: they bound what is broadcast and what a worker holds.
BLOCK_BYTES = 4 << 20
#: Rows of a tile that are multiplied with a block at a time.
STRIP = 512
#: Allowance for rounding in double precision.
ROUNDING = 1e-9


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, and upper bounds of the norm of what codes leave out."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    left = np.linalg.norm(u - q * scale[:, None], axis=1) * (1 + ROUNDING) + ROUNDING
    return q, scale, left


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, safe for very small and large components."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tile:
    """Some quantised vectors: names, numbers of copies, codes, scales, bounds, and the vectors themselves."""

    def __init__(self, table: pa.Table | pa.RecordBatch, d: int):
        raw = lambda c: b"".join(table.column(c).to_pylist())
        self.node, self.block = table.column("node").to_numpy(), table.column("block").to_numpy()
        self.weight = table.column("weight").to_numpy().astype(np.float64)
        n = len(self.node)
        self.code = np.frombuffer(raw("code"), np.int8).reshape(n, d)
        self.scale, self.left = table.column("scale").to_numpy(), table.column("rest").to_numpy()
        x = raw("x")
        self.x = np.frombuffer(x, "<f8" if len(x) == 8 * n * d else "<f4").reshape(n, d)

    def decoded(self, i: int = 0, j: int | None = None) -> np.ndarray:
        return self.code[i:j].astype(np.float32) * self.scale[i:j, None].astype(np.float32)


def links_between(x: Tile, y: Tile, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of x and y with cosine at least ``threshold``; ``right`` holds y's decoded codes, transposed."""
    # Codes times scales are rounded to single precision, and so are products and sums.
    rounding = (x.code.shape[1] + 4) * 2.0**-23 + ROUNDING
    most = float(y.left.max())
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(x.node), STRIP):
        near = x.decoded(i, i + STRIP) @ right
        own = x.left[i : i + STRIP]
        # No pair of the strip is off by more than this, so the rest is sorted out without a pass of its own.
        worst = float(own.max()) * (1 + most) + most + rounding
        at = np.flatnonzero(near >= np.float32(threshold - worst - 1e-6))
        a, b = at // near.shape[1], at % near.shape[1]
        once = (x.block[a + i] != y.block[b]) | (x.node[a + i] < y.node[b])
        a, b = a[once], b[once]
        value = near[a, b].astype(np.float64)
        error = own[a] + (1 + own[a]) * y.left[b] + rounding
        maybe = value + error >= threshold
        a, b, sure = a[maybe], b[maybe], (value - error > threshold)[maybe]
        for j in range(0, len(a), 1 << 16):
            part = np.flatnonzero(~sure[j : j + (1 << 16)]) + j
            sure[part] = np.einsum("ij,ij->i", unit(x.x[a[part] + i]), unit(y.x[b[part]])) >= threshold if len(part) else False
        found.append((a[sure] + i, b[sure]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


TALLY = "node long, links long, parent long"


def tally(node: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Weighted link counts and a spanning forest of the links (a[i], b[i]) between rows of ``node``."""
    links = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
    return tallied(node, links, local_roots(len(node), a, b))


def tallied(node: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    hit = np.flatnonzero(links)
    return pa.RecordBatch.from_pydict({"node": node[hit], "links": links[hit].astype(np.int64), "parent": node[root[hit]]})


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vec = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce(vec.isNotNull() & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0), F.lit(False))
    ids = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, vec).alias("v"))
    alone = ids.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    named = ids.where("v IS NOT NULL").withColumn("node", F.xxhash64(F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))))
    distinct = materialise(named.groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"), F.any_value("v").alias("v")), "vectors")
    stats = distinct.groupBy(F.size("v").alias("d")).count().collect()  # one row per vector length
    paths = [p for r in stats if r["count"] > 1 for p in _tallies(distinct.where(F.size("v") == r["d"]), r["d"], r["count"], threshold)]
    members = distinct.select("node", "first", (F.col("weight") - 1).alias("own"))
    if paths:
        found = rows.sparkSession.read.schema(TALLY).parquet(*paths)
        counted = found.groupBy("node").agg(F.sum("links").alias("links"))
        grouped = components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")))
        members = members.join(counted, "node", "left").join(grouped, "node", "left")
        members = members.select("node", "first", (F.col("own") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
        # Only members of components of two or more meet in the aggregate.
        smallest = members.where("component <> node OR n_links > 0").groupBy("component").agg(F.min("first").alias("component_id"))
        members = members.join(smallest, "component", "left").select("node", "n_links", F.coalesce("component_id", "first").alias("component_id"))
    else:
        members = members.select("node", F.col("own").alias("n_links"), F.col("first").alias("component_id"))
    placed = named.select("vec_id", "node").join(members, "node")
    return placed.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).union(alone)


def _tallies(distinct: DataFrame, d: int, n: int, threshold: float) -> list[str]:
    """Compare all vectors of one length; returns the paths of the tables of tallies, one per block."""
    spark = distinct.sparkSession
    blocks = -(-n * (13 * d + 40) // BLOCK_BYTES) if distinct.schema["v"].dataType.elementType.simpleString() == "double" else -(-n * (9 * d + 40) // BLOCK_BYTES)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy().reshape(-1, d)
            q, scale, left = quantise(unit(x))
            x = np.ascontiguousarray(x.astype(x.dtype.newbyteorder("<")))
            columns = [[r.tobytes() for r in q], scale, left, [r.tobytes() for r in x]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3)), *map(pa.array, columns)], ["node", "weight", "block", "code", "scale", "rest", "x"])

    # Hashes deal vectors evenly, so a block has few rows more than its share.
    block = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)).cast("int").alias("block")
    coded = distinct.select("node", "weight", "v", block).mapInArrow(code, "node long, weight long, block int, code binary, scale double, rest double, x binary")
    parts = max(blocks, 2 * spark.sparkContext.defaultParallelism)
    coded = materialise(coded.repartitionByRange(parts, "block", "node").sortWithinPartitions("block", "node"), "coded")
    paths = []
    for b in range(blocks):
        sent = spark.sparkContext.broadcast(Tile(coded.where(F.col("block") == b).toArrow(), d))

        paths.append(written(coded.where(F.col("block") >= b).mapInArrow(comparison(sent, d, threshold), TALLY), "tallies"))
        sent.unpersist()
    return paths


def comparison(sent: Broadcast, d: int, threshold: float):
    """What a task does with its tiles: tallies of their links with the block that was sent."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = sent.value
        n = len(y.node)
        if not n:
            return
        right = y.decoded().T.copy()
        links, root = np.zeros(n), np.arange(n)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = Tile(batch, d)
            a, b = links_between(x, y, right, threshold)
            links += np.bincount(b, x.weight[a], n)
            # Numbers of the block come first, and roots are smallest numbers, so roots of the block stay in it.
            both = local_roots(n + len(x.node), np.concatenate((np.arange(n), a + n)), np.concatenate((root, b)))
            root = both[:n]
            own = np.concatenate((np.zeros(n), np.bincount(a, y.weight[b], len(x.node))))
            yield tallied(np.concatenate((y.node, x.node)), own, both)
        yield tallied(y.node, links, root)

    return compare
