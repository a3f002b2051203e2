"""XML text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Characters that XML 1.0 has not become U+FFFD."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "�")


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped(c: Column) -> Column:
    return _swap(clean(c), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def quoted(c: Column) -> Column:
    return _swap(escaped(c), ('"', "&quot;"), ("'", "&apos;"))


def cdata(c: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), _swap(clean(c), ("]]>", "]]]]><![CDATA[>")), F.lit("]]>"))


def attribute(name: str, value: Column) -> Column:
    """name="value", or null where the value is null or empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f'{name}="'), quoted(value), F.lit('"')))


def tag(name: str, *attributes: Column) -> Column:
    return F.concat(F.concat_ws(" ", F.lit(f"<{name}"), *attributes), F.lit("/>"))
