"""Input tables and small column helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit key of a row's id and text: rows that share it are repetitions and get the same answer."""
    return F.xxhash64(F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).isNull(), F.coalesce(F.col(text_col), F.lit("")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a sieve: SIEVE / 64 rows of 64 bits are broadcast at most, at any size.
SIEVE = 1 << 24


def sieved(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The ``rows`` whose hash ``name`` may be among those of ``keys``, for an exact join that then shuffles fewer rows.

    Keeps all that are among them, and of the others about one in SIEVE / (number of keys); with far more keys than
    SIEVE nearly all rows pass and the exact join alone decides. That join must be an inner one with distinct keys: the
    optimizer would move a semi-join below the sieve.
    """
    place = F.pmod(F.col(name), F.lit(SIEVE))
    word, bit = F.floor(place / 64).cast("int"), (place % 64).cast("int")
    word_name, bits = fresh(rows, "sieve_word"), fresh(rows, "sieve_bits")
    marks = keys.select(word.alias(word_name), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias(bits))
    marks = marks.groupBy(word_name).agg(F.bit_or(bits).alias(bits))
    held = rows.withColumn(word_name, word).join(F.broadcast(marks), word_name).where(F.getbit(F.col(bits), bit) == 1)
    return held.drop(word_name, bits)
