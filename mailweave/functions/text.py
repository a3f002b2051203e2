"""Names, sizes, dates and subjects as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
DEVICE_NAMES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])"
REPLY_PREFIXES = "re|fwd|fw|aw|wg|antwort|sv|vs|tr|回复|回覆|答复|転送"
INLINE_EXTENSIONS = ["txt", "md", "csv", "tsv", "json", "log", "xml", "yml", "yaml", "ics"]
MIME_TYPES = {
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "heic": "image/heic",
    "svg": "image/svg+xml",
    "zip": "application/zip",
    "txt": "text/plain",
    "csv": "text/csv",
    "tsv": "text/tab-separated-values",
    "json": "application/json",
    "xml": "application/xml",
    "ics": "text/calendar",
    "md": "text/markdown",
    "log": "text/plain",
    "yml": "text/yaml",
    "yaml": "text/yaml",
    "mp4": "video/mp4",
    "mov": "video/quicktime",
    "mp3": "audio/mpeg",
    "eml": "message/rfc822",
}
_MIME_FORM = r"\A[A-Za-z0-9!#$&^_.+-]+/[A-Za-z0-9!#$&^_.+-]+\z"
_ODD_SPACES = r"[\u00a0\u2000-\u200b\u202f\u205f\u3000]"


_DATES = ("MMM d, yyyy h:mm a", "MMM d, yyyy H:mm", "MMMM d, yyyy h:mm a", "MMMM d, yyyy H:mm", "d MMM yyyy H:mm", "d MMM yyyy h:mm a", "d MMMM yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy")


def normalized(c: Column, form: str) -> Column:
    """Unicode normalisation, which Spark has no function for."""
    return F.pandas_udf(lambda s: pd.Series([None if x is None else unicodedata.normalize(form, x) for x in s], dtype=object), StringType())(c)


def _each(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def slug(c: Column, folder: bool = True) -> Column:
    """A folder name: letters and digits joined by hyphens, 60 characters at most.

    A ``folder`` may not bear a device's name, and control characters vanish from it; else they part words like any other.
    """
    controls = ((r"[\x00-\x1f\x7f]", ""),) if folder else ()
    s = _each(F.lower(F.coalesce(c, F.lit(""))), *controls, (r"[^\p{L}\p{N}]+", "-"), ("^-+|-+$", ""))
    s = F.regexp_replace(F.substring(s, 1, 60), "-+$", "")
    named = F.when(s == "", F.lit("thread"))
    return (named.when(s.rlike(DEVICE_NAMES + "$"), F.concat(F.lit("_"), s)) if folder else named).otherwise(s)


def file_name(c: Column, fallback: str = "attachment") -> Column:
    """A safe file name of at most 100 characters that keeps its extension."""
    n = _each(normalized(F.coalesce(c, F.lit("")), "NFC"), (r"[\x00-\x1f\x7f]", ""), (r"[/\\]", "_"), (r"[^\p{L}\p{N}._ ()-]", "_"), (r"\.{2,}", "."), (r"^[.\s]+", ""), ("_{2,}", "_"), (r"\s{2,}", " "), (r"\s+\.", "."), (r"[.\s]+$", ""))
    n = F.when(n == "", F.lit(fallback)).otherwise(n)
    n = F.when(n.rlike(DEVICE_NAMES + r"(\.|$)"), F.concat(F.lit("_"), n)).otherwise(n)
    ext = F.regexp_extract(n, r"(\.[\p{L}\p{N}]{1,8})$", 1)
    return F.when(F.length(n) > 100, F.concat(F.trim(n.substr(F.lit(1), 100 - F.length(ext))), ext)).otherwise(n)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"\.([A-Za-z0-9]{1,8})$", 1))


def mime_type(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension(c)), F.lit(""))


def clean_type(declared: Column, name: Column) -> Column:
    """A declared type of the right form, else the one of the name's extension; null if neither is there."""
    own = F.trim(F.coalesce(declared, F.lit("")))
    return F.when(own.rlike(_MIME_FORM), own).otherwise(F.nullif(mime_type(name), F.lit("")))


def plain_address(c: Column) -> Column:
    """``Name <address>`` as ``Name (address)``, without angles that read as markup."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    form = r"\A(.*?)[<〈]\s*([^>〉]+?)\s*[>〉]\z"
    name = F.regexp_replace(F.trim(F.regexp_extract(raw, form, 1)), "^[\"']|[\"']$", "")
    email = F.trim(F.regexp_extract(raw, form, 2))
    return F.when(~raw.rlike(form), raw).when((name != "") & (name != email), F.concat(name, F.lit(" ("), email, F.lit(")"))).otherwise(email)


def inlineable(c: Column) -> Column:
    return extension(c).isin(INLINE_EXTENSIONS)


def size_text(c: Column, ties: str = "up") -> Column:
    """A size for display; tenths of MB that are exactly half-way go up, as browsers round, or to the ``even`` one, as printf does."""
    n = c.cast("double")
    tenths = n * 10 / (1 << 20)  # exact where it is half-way
    mb = F.format_string("%.1f", F.rint(tenths) / 10 if ties == "even" else n / (1 << 20))
    return F.when(n.isNull() | (n < 0), "unknown size").when(n < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def size_bytes(c: Column) -> Column:
    """Bytes of a displayed size; null if it is none."""
    raw = F.trim(F.regexp_replace(c, "^([^,]*),", "$1."))
    form = r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*(B|K|KB|M|MB|G|GB)$"
    unit = F.upper(F.regexp_extract(raw, form, 2)).substr(1, 1)
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.when(raw.rlike(form), F.floor(F.regexp_extract(raw, form, 1).try_cast("double") * factor + 0.5).cast("long"))


def iso_time(c: Column, zone: str | Column = "UTC") -> Column:
    """ISO time in UTC of a displayed local time; null outside 1990 to 2100 or if it can't be read."""
    # The first "at" goes, and the weekday, which is not checked.
    raw = F.trim(_each(c, (_ODD_SPACES, " "), (r"(?is)^(.*?)(?<![a-z0-9_])at(?![a-z0-9_])", "$1 "), (r"\s+", " ")))
    raw = F.regexp_replace(raw, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +", "")
    at = F.coalesce(*(F.try_to_timestamp(raw, F.lit(p)) for p in _DATES))
    at = F.to_utc_timestamp(at, zone)
    return F.when(F.year(at).between(1990, 2100), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def folded_subject(c: Column) -> Column:
    """Lower case without reply prefixes, white space squeezed."""
    s = F.lower(F.regexp_replace(normalized(F.coalesce(c, F.lit("")), "NFKC"), _ODD_SPACES, " "))
    return F.trim(_each(s, (rf"^(?:\s*(?:{REPLY_PREFIXES})\s*[:：]\s*)+", ""), (r"\s+", " ")))


def plain_subject(c: Column) -> Column:
    return F.trim(F.regexp_replace(folded_subject(c), r"[\p{P}\p{Z}]+", " "))


def same_subject(a: Column, b: Column) -> Column:
    """Equal without punctuation; subjects of punctuation only must be equal as they are, missing ones never match."""
    x, y, u, v = plain_subject(a), plain_subject(b), folded_subject(a), folded_subject(b)
    return F.when((x != "") & (y != ""), x == y).otherwise((u != "") & (u == v))
