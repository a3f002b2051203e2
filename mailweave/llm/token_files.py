"""Operator 7, token-ID output: flat unsigned integer files with 64-bit document offsets.

Format of a token folder: ``part-NNNNN.bin`` holds the ids of consecutive
documents as little-endian unsigned integers (16 bits if the vocabulary fits,
else 32), ``part-NNNNN.idx`` holds (doc_id int64, end offset in ids uint64,
id-is-null uint64) records, both made to be memory-mapped. A part's place in the
whole stream is the prefix sum of the parts before it.

Documents are range-sorted by id (null ids first), and encoded where they are
written: ids take as much room as texts, so nothing is gained by sorting them instead.
Documents of one id are ordered by a hash of their text and then by their place in
the input, and may lie in several parts, so a much repeated id is no hot key. Each task writes one part under a temporary name
and renames it, so a task that runs again leaves the same file. A null text is
empty: its only token is the end id. Other columns are ignored. The folder must be
visible to all executors as a file path; any other kind of path is refused.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.encoding import encoder
from mailweave.llm.store import scratch
from mailweave.llm.text import as_bytes, text_slices

RECORD = np.dtype([("doc_id", "<i8"), ("end", "<u8"), ("null", "<u8")])
#: Bytes of text per part.
PART_BYTES = 16 << 20


def local_path(path: str) -> str:
    """A plain path or a file: URI as a plain path."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"token files are memory-mapped, so their folder must be a file path, not {path}")
    return path


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None) -> list[tuple[int, int, int]]:
    """Write all documents in ascending doc_id order; returns (part, documents, tokens) of each part."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if parts is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(docs.sparkSession.sparkContext.defaultParallelism, total // PART_BYTES + 1)
    root = local_path(folder)
    os.makedirs(root, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        k, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = f"{root}/part-{k:05d}"
        os.makedirs(root, exist_ok=True)
        n = documents = 0
        with open(f"{name}.bin.{attempt}", "wb") as ids, open(f"{name}.idx.{attempt}", "wb") as index:
            for batch in batches:
                known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                records = np.zeros(batch.num_rows, RECORD)
                records["doc_id"], records["null"] = batch.column(0).fill_null(0).to_numpy(), ~known
                texts = as_bytes(batch.column(1))
                for i, j in text_slices(texts, 4 << 20):
                    coded, sizes = enc.encode(texts[i:j], end_id)
                    records["end"][i:j] = n + np.cumsum(sizes)
                    n += len(coded)
                    ids.write(coded.tobytes())
                index.write(records.tobytes())
                documents += batch.num_rows
        for kind in ("bin", "idx"):
            os.replace(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [k], "documents": [documents], "tokens": [n]})

    order = ["doc_id", "h", "row"]
    keyed = docs.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = ordered.mapInArrow(write, "part long, documents long, tokens long").collect()  # a row for each part
    return sorted((r.part, r.documents, r.tokens) for r in rows)


def read_token_files(spark, folder: str, parts: list[tuple[int, int, int]], tokenizer: str) -> DataFrame:
    """Map the files and return each document's place, length and checksum over 32-bit ids."""
    root, before, spec = local_path(folder), 0, []
    for part, _, tokens in parts:
        spec.append((part, before))
        before += tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{root}/part-{part:05d}"
                if not os.path.getsize(f"{name}.idx"):
                    continue
                index, ids = np.memmap(f"{name}.idx", RECORD, "r"), np.memmap(f"{name}.bin", dtype, "r")
                for i in range(0, len(index), 4096):
                    own = index[i : i + 4096]
                    ends = own["end"].astype(np.int64)
                    starts = np.concatenate(([index["end"][i - 1] if i else 0], ends[:-1])).astype(np.int64)
                    sums = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own["doc_id"], pa.int64(), mask=own["null"] == 1), pa.array(starts + base), pa.array(ends - starts), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    rows = spark.createDataFrame(spec or [(0, 0)], "part long, base long").where(F.lit(bool(spec)))
    return rows.repartition(max(1, len(spec))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents into a new folder of the shared store and read them back."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer, end_id), tokenizer)
