"""Five corpus operators in a row: quality, lines, near copies, mixing, packing.

Each stage keeps null texts, empty and repeated rows as its operator states; columns other than doc_id, text and lang
are carried along, whatever their names, up to packing. Mixing targets are relative to what is left, as the stages
before have already taken most poor documents out: rates of clean documents stay near 1, so few are repeated or left
out. The result has a row for each piece of each document, with its token ids; a document that mixing repeats is packed
each time, so (doc_id, piece) can recur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailweave.llm import line_templates, mixture, ngram_join, packing, perplexity
from mailweave.llm.queries import tokenizer_file
from mailweave.llm.store import materialise
from mailweave.llm.tables import read

#: Tokens that each domain should have after mixing, against those that the stages before leave it.
FACTORS = {"good": 1.0, "poor": 1.0, "toxic": 0.5}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judge = perplexity.train(docs, read(spark, sf_dir, "labels"))
    good = perplexity.keep_good(docs, judge)
    judge.close()
    return good


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.drop_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mixed(docs, read(spark, sf_dir, "labels"), FACTORS, None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixing", mixing), ("packing", packed)]
#: Perplexity bands, MinHash and tokenising have no SQL. Tests hold run() on a small fixture against the operators' brute-force rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
