"""The registered query of each corpus operator, over its whole table and with production parameters."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from mailweave.llm import line_templates, lm, mixture, ngram_join, packing, perplexity, repeats, token_files, vector_dedup, wordpiece
from mailweave.llm.tables import read

#: Shares of all tokens that each domain should have.
TARGETS = {"good": 0.8, "poor": 0.15, "toxic": 0.05}
#: All tokens of the mix against those of the documents.
EPOCHS = 1.25


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), TARGETS, EPOCHS)


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digest(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(read(spark, sf_dir, "documents"))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    judge = perplexity.train(docs, read(spark, sf_dir, "labels"))
    found = perplexity.quality(docs, judge)
    judge.close()
    return found


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 1)


def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(read(spark, sf_dir, "documents"))


def op9_quantised_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {k: f for k, f in vars(sys.modules[__name__]).items() if k.startswith("op") and callable(f)}
    return {**found, "pipeline": pipeline}


#: All pairs of vectors by cosine, and what is reachable by links.
_VECTORS = """WITH RECURSIVE a AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT * FROM a WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT x.r AS x, y.r AS y FROM v x JOIN v y ON x.r <> y.r AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT r AS x, r AS y FROM a UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN a ON y = r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM a JOIN c ON r = c.x LEFT JOIN n ON r = n.x"""


def oracle_sql() -> dict[str, str]:
    return {"op9_quantised_tiles": _VECTORS}
