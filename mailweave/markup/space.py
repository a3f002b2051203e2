"""White space and lengths as browsers see them."""

from __future__ import annotations

import re

SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
RUN = re.compile(f"[{SPACES}]+")
_EDGES = re.compile(rf"\A[{SPACES}]+|[{SPACES}]+\Z")
_END = re.compile(rf"[{SPACES}]+\Z")


def strip(s: str) -> str:
    return _EDGES.sub("", s)


def strip_end(s: str) -> str:
    return _END.sub("", s)


def squeeze(s: str) -> str:
    return RUN.sub(" ", s)


def units(s: str) -> int:
    """Length in UTF-16 units."""
    return len(s) + sum(c > "\uffff" for c in s)


def head(s: str, n: int) -> str:
    """The first ``n`` UTF-16 units; half a character is left out."""
    if units(s) <= n:
        return s
    return s.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "ignore")
