"""What a capture reports about itself: completeness, warnings, counters and a summary line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.functions import policy, text, urls

#: A document of more bytes or messages than these has its size told, and the wait for a file name.
LARGE_BYTES, LARGE_MESSAGES, NAME_WAIT_MS = 400 << 10, 150, 5000
_NONE = "cast(array() as array<struct<code: string, message: string>>)"


def complete(messages: Column, headers: Column, attachments: Column) -> Column:
    """True only if all three are true."""
    return F.coalesce(messages, F.lit(False)) & F.coalesce(headers, F.lit(False)) & F.coalesce(attachments, F.lit(False))


def folded(messages: DataFrame, expected: str = "candidates") -> DataFrame:
    """Completeness of threads from messages(thread_id, candidates, recognised, header_ok, attachments_ok, trimmed, kept_quotes).

    Every candidate must be recognised, and every header and attachment verified; one that is not recognised verifies nothing.
    """
    seen = F.coalesce("recognised", F.lit(False))
    all_of = lambda c: F.bool_and(seen & F.coalesce(c, F.lit(False)))
    return messages.groupBy("thread_id").agg(
        (F.count_if(seen) == F.max(expected)).alias("messages_complete"), all_of("header_ok").alias("headers_complete"), all_of("attachments_ok").alias("attachments_complete"),
        F.bool_or(F.coalesce("trimmed", F.lit(False))).alias("quoted_trimmed"), F.coalesce(F.sum("kept_quotes"), F.lit(0)).alias("kept_quotes"),
    )


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """warnings(thread_id, ord, code, message) without those that a thread has had before."""
    same = Window.partitionBy("thread_id", "code", "message").orderBy("ord")
    return warnings.withColumn("again", F.row_number().over(same)).where("again = 1").drop("again")


def _told(code: str, condition: Column, message: str, count: Column | None = None) -> Column:
    said = F.lit(message) if count is None else F.concat(count.cast("string"), F.lit(message))
    return F.when(condition, F.struct(F.lit(code).alias("code"), said.alias("message")))


def collection_warnings() -> Column:
    """Warnings about collected attachments, from the columns of ``attachments.counters``; an array in their order."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return F.array_compact(F.array(
        _told("ATTACHMENT_UNAVAILABLE", (n("unsafe") > 0) | (n("no_link") > 0), "At least one attachment lacked a verified Gmail download link and was not fetched."),
        _told("DOWNLOAD_FAILED", n("download_failed") > 0, " download(s) failed to start.", n("download_failed")),
        _told("INLINE_ATTACHMENT_FAILED", n("inline_failed") > 0, " text attachment(s) could not be read.", n("inline_failed")),
        _told("INLINE_ATTACHMENT_LIMIT", n("inline_skipped") > 0, " text attachment(s) were not inlined because the per-thread text limit was reached.", n("inline_skipped")),
        _told("INLINE_ATTACHMENT_TRUNCATED", n("inline_truncated") > 0, " text attachment(s) were truncated at a safe limit.", n("inline_truncated")),
        _told("DOWNLOAD_SKIPPED", n("skipped") > 0, " attachment(s) exceeded the safe download limit.", n("skipped")),
    ))


def reported(threads: DataFrame, counted: DataFrame | None) -> DataFrame:
    """Threads of ``captures.parsed`` as ``threads.documents`` takes them; without counters, attachments could not be processed."""
    t = threads.where("thread.status = 'ok'").select(
        "thread_id", "subject", "timezone", urls.thread_url(F.col("account_index"), F.col("thread_id")).alias("url"), "thread.source", "thread.expected", "thread.quoted_trimmed",
        "thread.messages_complete", "thread.headers_complete", "thread.attachments_complete", F.coalesce("thread.warnings", F.expr(_NONE)).alias("warnings"),
    )
    if counted is None:
        failed = F.array(F.struct(F.lit("ATTACHMENT_PROCESSING_FAILED").alias("code"), F.lit("Attachment processing failed; message text was still copied.").alias("message")))
        return t.withColumn("warnings", F.array_distinct(F.concat("warnings", failed))).withColumn("attachments_complete", F.lit(False))
    t = t.join(counted, "thread_id", "left")
    missed = (F.coalesce("unsafe", F.lit(0)) > 0) | (F.coalesce("no_link", F.lit(0)) > 0)
    out = t.withColumn("warnings", F.array_distinct(F.concat("warnings", collection_warnings()))).withColumn("attachments_complete", F.col("attachments_complete") & ~missed)
    return out.drop(*(c for c in counted.columns if c != "thread_id"))


def summary(messages: Column, counters: dict[str, Column], trimmed: Column, size: Column, whole: Column) -> Column:
    """One line that says what was copied, and whether warnings should be read."""
    n = lambda c: F.coalesce(counters[c], F.lit(0))

    def some(count: Column, one: str, more: str, after: str = "") -> Column:
        return F.concat(count.cast("string"), F.when(count == 1, f" {one}").otherwise(f" {more}"), F.lit(after))

    plain = {"inlined": "inlined", "inline_failed": "inline read failed", "inline_skipped": "not inlined", "inline_truncated": "truncated"}
    parts = [some(messages, "message", "messages"), F.when(n("total") > 0, some(n("total"), "attachment", "attachments"))]
    parts += [F.when(n(c) > 0, F.concat(n(c).cast("string"), F.lit(f" {t}"))) for c, t in plain.items()]
    parts += [F.when(n(c) > 0, some(n(c), "download", "downloads", t)) for c, t in (("download_started", " started"), ("download_failed", " failed"))]
    parts += [F.when(n("skipped") > 0, F.concat(n("skipped").cast("string"), F.lit(" skipped"))), F.when(trimmed, "quoted text trimmed")]
    parts.append(F.when((size > LARGE_BYTES) | (messages > LARGE_MESSAGES), size_notice(size)))
    line = F.concat_ws(" · ", *parts)
    doubtful = ~whole
    for c in ("download_failed", "skipped", "inline_failed", "inline_skipped", "inline_truncated", "unsafe", "no_link"):
        doubtful = doubtful | (n(c) > 0)
    return F.when(doubtful, F.concat(F.lit("⚠ Copied "), line, F.lit(" — review warnings in the pasted output"))).otherwise(F.concat(F.lit("✓ Copied "), line))


def size_notice(size: Column) -> Column:
    kb = F.concat(F.floor(size / 1024 + 0.5).cast("string"), F.lit(" KB"))
    return F.when(size < 1 << 20, kb).otherwise(text.size_text(size))


def settled(requests: DataFrame, events: DataFrame, wait_ms: int = NAME_WAIT_MS) -> DataFrame:
    """(download_id, ok, path, status, error) of requests(download_id, at, path) from events(download_id, at, state, filename).

    The first event that interrupts a download or names its file within the wait decides; without one, the path asked for
    stands, unverified. Of events at one time an interruption comes first. Events of other downloads are ignored.
    """
    stopped = F.col("e.state") == "interrupted"
    told = F.coalesce(stopped, F.lit(False)) | (F.coalesce("e.filename", F.lit("")) != "")
    close = F.col("e.at") <= F.col("r.at") + F.expr(f"INTERVAL {wait_ms / 1000:f} SECONDS")
    both = requests.alias("r").join(events.alias("e"), (F.col("r.download_id") == F.col("e.download_id")) & told & close, "left")
    when = F.struct(F.col("e.at").alias("at"), F.when(stopped, 0).otherwise(1).alias("k"), F.col("e.filename").alias("file"))
    first = both.groupBy(F.col("r.download_id").alias("download_id"), F.col("r.path").alias("path")).agg(F.min(F.when(told, when)).alias("w"))
    ok = F.coalesce(F.col("w.k") == 1, F.lit(True))
    place = F.when(F.col("w").isNull(), F.col("path")).when(ok, policy.reported_path(F.col("w.file"), F.col("path")))
    status = F.when(F.col("w").isNull(), "download started (path unverified)").when(ok, "download started")
    return first.select("download_id", ok.alias("ok"), place.alias("path"), status.alias("status"), F.when(~ok, "download interrupted").alias("error"))
