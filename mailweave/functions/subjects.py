"""Whether a title or subject names the same conversation; missing ones never do."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from mailweave.functions.text import REPLY_PREFIXES
from mailweave.markup.space import squeeze, strip

_PREFIXES = re.compile(rf"(?:\s*(?:{REPLY_PREFIXES})\s*[:：]\s*)+", re.I)
_SEPARATOR = re.compile(r"\s+[-–—]\s+")
_DECORATION = re.compile(r"gmail|.*(?<![A-Za-z0-9_])mail|[^\s@]+@[^\s@]+\.[^\s@]+", re.I | re.S)
MOST_SEGMENTS = 8


def fold(subject: str | None) -> str:
    text = unicodedata.normalize("NFKC", subject or "").lower()
    return squeeze(strip(_PREFIXES.sub("", text, count=1) if _PREFIXES.match(text) else text))


def plain(subject: str | None) -> str:
    marks = "".join(" " if unicodedata.category(c)[0] in "PZ" else c for c in fold(subject))
    return strip(re.sub(" +", " ", marks))


def same(a: str | None, b: str | None) -> bool:
    x, y = plain(a), plain(b)
    return x == y if x and y else fold(a) == fold(b) != ""


def decoration(segment: str) -> bool:
    """Whether a segment of a title may be something else than the subject: nothing, a product or company's mail, or an address."""
    text = strip(segment)
    return not text or bool(_DECORATION.fullmatch(text))


def title_matches(title: str | None, subject: str | None) -> bool:
    """Whether a title is the subject with nothing but decorations before and after it."""
    text = strip(title or "")
    if not text or not strip(subject or ""):
        return False
    if same(text, subject):
        return True
    parts = _SEPARATOR.split(text)
    n = len(parts)
    if not 2 <= n <= MOST_SEGMENTS:
        return False
    lead = next((k for k, p in enumerate(parts) if not decoration(p)), n)
    last = next((k for k, p in enumerate(reversed(parts[lead:])) if not decoration(p)), n - lead)
    return any(same(" - ".join(parts[i:j]), subject) for i in range(lead + 1) for j in range(n - last, n + 1) if i < j)


def _titles(title: pd.Series, subject: pd.Series) -> pd.Series:
    return pd.Series([title_matches(t, s) for t, s in zip(title, subject, strict=True)], dtype=bool)


title_matches_of = F.pandas_udf(_titles, BooleanType())
