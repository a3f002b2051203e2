"""Quoted history and signatures cut from message bodies, in one Arrow pass."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweave.markup.space import units

# The phrases that open quoted history, name its placeholders, and close a letter.
FORWARD = re.compile(r"-{2,}\s*(forwarded message|weitergeleitete nachricht|message transf)", re.I)
# Words begin at borders between ASCII letters, digits or _ and anything else, and end before anything but a letter, digit or _
# of any script: "Onè" does not open with the word "On".
_B, _E = "(?<![A-Za-z0-9_])", r"(?!\w)"
CHAINS = [rf"^[ \t]*On{_E}[\s\S]{{0,400}}?{_B}wrote:[ \t]*$", rf"^[ \t]*Am{_E}[\s\S]{{0,400}}?{_B}schrieb{_E}[\s\S]{{0,200}}?:[ \t]*$", rf"^[ \t]*Le{_E}[\s\S]{{0,400}}?{_B}a écrit\s*:[ \t]*$"]
HEADERS = [r"(?i)^[ \t]*-{2,}\s*Original Message\s*-{2,}[ \t]*$", r"(?i)^[ \t]*From:[ \t]*\S[^\n]*\r?\n[ \t]*Sent:[ \t]*", r"^[ \t]*发件人\s*[:：][^\n]*\r?\n[ \t]*(?:到|收件人)\s*[:：]"]
PLACEHOLDER = re.compile(r"^[ \t]*\[?(Quoted text hidden|Message clipped|Zitierter Text ausgeblendet)\]?[ \t]*$", re.I | re.M)
CLOSINGS = "best regards|kind regards|warm regards|best wishes|best|regards|sincerely|thanks|thank you|cheers|mit freundlichen grüßen|viele grüße|beste grüße"
CLOSING = re.compile(rf"^[ \t]*({CLOSINGS})[,!]?[ \t]*$", re.I | re.M)
OPENERS = [(re.compile(p, re.M), p in CHAINS) for p in CHAINS + HEADERS]
DELIMITER, POSTSCRIPT = re.compile(r"^-- ?[ \t]*$", re.M), re.compile(rf"{_B}P\.?S\.?[:.\s]|\?")
INLINE_REPLY, SIGN_OFF_CHARS, SIGN_OFF_LINES = 80, 320, 8


def _without_history(text: str) -> str:
    hits = [(m.start(), k, m.end(), chain) for k, (p, chain) in enumerate(OPENERS) if (m := p.search(text))]
    if not hits:
        return text
    start, _, end, chain = min(hits)
    prose = " ".join(x for x in text[end:].split("\n") if x.strip() and not x.lstrip().startswith(">")).strip()
    return text if chain and units(prose) > INLINE_REPLY else text[:start]


def _without_signature(text: str) -> str:
    m = DELIMITER.search(text)
    if m and units(text[: m.start()]) > units(text) / 2:
        text = text[: m.start()]
    closing = list(CLOSING.finditer(text))
    if not closing:
        return text
    tail, kept = text[closing[-1].end() :], text[: closing[-1].start()].rstrip()
    long = units(tail) > SIGN_OFF_CHARS or sum(bool(x.strip()) for x in tail.split("\n")) > SIGN_OFF_LINES
    return text if long or POSTSCRIPT.search(tail) or not kept else kept


def trim(body: str | None) -> tuple[str, bool, bool]:
    """(text, trimmed, elided); a null body is empty, forwards stay, nothing but a placeholder is elided."""
    body = body or ""
    if not body.strip() or FORWARD.search(body):
        return body, False, False
    cut = _without_signature(_without_history(body))
    shown = PLACEHOLDER.sub("", cut)
    text = re.sub(r"\n{3,}", "\n\n", shown).rstrip()
    if not text:
        return ("", True, True) if shown != cut else (body, False, False)
    return text, len(text) != len(body), False


def _trim_rows(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(map(trim, bodies), columns=["text", "trimmed", "elided"])


def trimmed(c: Column) -> Column:
    """trim() as a struct column."""
    return F.pandas_udf(_trim_rows, "text string, trimmed boolean, elided boolean")(c)
