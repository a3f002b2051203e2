"""Tables of the driver as threads, messages and attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages of a thread."""
    c = table(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.col("turn").cast("int"))
    email = F.concat("role", F.lit("@example.com"))
    return c.select(
        F.concat(F.lit("thread-"), F.col("conv_id").cast("string")).alias("thread_id"), (F.col("turn") + 1).alias("n"), F.when(F.col("turn") > 0, F.col("role")).otherwise("").alias("name"), email.alias("email"),
        F.date_format(day, "yyyy-MM-dd'T'09:30:00.000'Z'").alias("date"), F.date_format(day, "EEE, MMM d, yyyy 'at' '9:30 AM'").alias("local"), F.col("text").alias("body"),
    )


def captures(spark: SparkSession, paths: str, limit: int = 25 << 20) -> DataFrame:
    """Print views of a folder, at most ``limit`` bytes each; the filter reaches the scan."""
    return spark.read.format("binaryFile").load(paths).where(F.col("length") <= limit).select("path", F.decode("content", "utf-8").alias("html"))
