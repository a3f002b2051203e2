"""From captured pages to documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.operators import attachments, captures, outcomes, threads


@dataclass
class Run:
    """The documents, a summary line for each, and the captures that were refused."""

    documents: DataFrame
    summaries: DataFrame
    refused: DataFrame


def run(pages: DataFrame, files: DataFrame, results: DataFrame | None = None) -> Run:
    """All steps for pages(thread_id, account_index, subject, timezone, html, live_html).

    files and results are those of ``attachments.collected``. Pages are parsed once; the rows stay with the executors and
    are parsed again where one is lost.
    """
    parsed = captures.parsed(pages).persist(StorageLevel.MEMORY_AND_DISK)
    done = attachments.collected(captures.items(parsed), files, results)
    counted = attachments.counters(done)
    said = captures.messages(parsed)
    told = outcomes.reported(parsed, counted)
    docs = threads.documents(told, said, done)
    whole = outcomes.complete(*(F.col(f"{x}_complete") for x in ("messages", "headers", "attachments")))
    about = told.select("thread_id", "quoted_trimmed", whole.alias("whole")).join(said.groupBy("thread_id").agg(F.count("*").alias("n")), "thread_id").join(counted, "thread_id", "left")
    about = about.join(docs.select("thread_id", F.octet_length("document").alias("bytes")), "thread_id")
    line = outcomes.summary(F.col("n"), {c: F.col(c) for c in counted.columns[1:]}, F.col("quoted_trimmed"), F.col("bytes"), F.col("whole"))
    return Run(docs, about.select("thread_id", line.alias("summary")), parsed.where("thread.status <> 'ok'").select("thread_id", "thread.status", "thread.title"))
