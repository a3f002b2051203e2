"""What thread ids, paths and header lines are accepted, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions import urls
from mailweave.functions.text import DEVICE_NAMES

ROOT = "gmail-threads"  # fixed value
# Labels of recipient lines.
LABELS = {"bcc": "bcc|blind copy|密送|密件副本", "cc": "cc|copy|kopie|抄送|副本", "to": "to|an|à|para|收件人|到|宛先"}


def valid_thread_id(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"\A[A-Za-z0-9._:-]{4,256}\z")


def safe_path(c: Column) -> Column:
    """A relative path below the root folder that no system reads in another way."""
    path = F.coalesce(c, F.lit(""))
    parts = F.split(path, "/")

    def fine(p: Column) -> Column:
        stem = F.regexp_replace(F.substring_index(p, ".", 1), "[. ]+$", "")
        return (p != "") & ~p.rlike("[. ]$") & ~stem.rlike(DEVICE_NAMES + "$")

    return (F.length(path).between(1, 240)) & ~path.rlike(r'[\x00-\x1f\x7f\\:*?"<>|]') & (F.get(parts, F.lit(0)) == ROOT) & (F.size(parts) >= 3) & F.forall(parts, fine)


def recipient_kind(line: Column) -> Column:
    """bcc, cc or to by the label of a header line; null without a known label and colon."""
    out = F.lit(None).cast("string")
    for kind in ("to", "cc", "bcc"):
        out = F.when(line.rlike(rf"(?iu)^(?:{LABELS[kind]})\s*[:：]"), kind).otherwise(out)
    return out


def recipient_value(line: Column) -> Column:
    return F.regexp_replace(line, rf"(?iu)^(?:{'|'.join(LABELS.values())})\s*[:：]\s*", "")


def reported_path(actual: Column, requested: Column) -> Column:
    """The part of a saved file's place from the last root folder on, else the path that was asked for."""
    slashed = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))
    found = F.regexp_extract(slashed(actual), f"(?s)^.*/({ROOT}/.*)$", 1)
    return F.when(found != "", found).otherwise(slashed(requested))


def authorized(requests: DataFrame) -> DataFrame:
    """Adds ok, error and the granted url to requests(type, url, path, thread_id, sender_id, frame_id, tab_url, runtime_id).

    The account is that of the sender's page, never one that the message names; anything missing is rejected.
    """
    account = urls.account_of(F.col("tab_url"))
    known = (F.col("type") == "download") & (F.coalesce("runtime_id", F.lit("")) != "") & (F.col("sender_id") == F.col("runtime_id")) & (F.col("frame_id") == 0)
    known = F.coalesce(known & F.col("tab_url").startswith(f"https://{urls.HOST}/") & F.col("account").isNotNull(), F.lit(False))
    safe = F.col("granted").isNotNull() & safe_path(F.col("path"))
    asked = requests.withColumn("account", account).withColumn("granted", urls.attachment_url_of(F.col("url"), F.col("thread_id"), F.col("account")))
    error = F.when(~known, "download request rejected").when(~safe, "unsafe download request rejected")
    return asked.withColumn("error", error).withColumn("ok", F.col("error").isNull()).withColumn("granted", F.when(F.col("ok"), F.col("granted"))).drop("account")


def attachment_status(rejected: Column, url: Column, size: Column, save: bool, limit: int = 25 << 20) -> Column:
    wait = F.when(size > limit, "not downloaded: exceeds 25.0 MB limit").otherwise("download started") if save else F.lit("not downloaded (use Copy + save files)")
    return F.when(rejected, "unsafe download link rejected").when(F.coalesce(url, F.lit("")) == "", "no Gmail download link found").otherwise(wait)
