"""Quoted history and signatures cut out of an HTML tree."""

from __future__ import annotations

import re

from mailweave.markup.space import squeeze, strip, units
from mailweave.markup.tree import Node

#: Fixed value: prose of more UTF-16 units than this beside quoted lines may be an answer.
INLINE_REPLY = 80
_LINE_ENDS = {"div", "p", "li", "blockquote"}
_INTRO = re.compile(r"On(?![A-Za-z0-9_]).*wrote:|Am(?![A-Za-z0-9_]).*schrieb.*:|Le(?![A-Za-z0-9_]).*a écrit\s*:", re.I)

# Elements that hold signatures and quoted history, and those that begin it.
_SIGNATURE = lambda n: n.is_a("div", "gmail_signature")
_QUOTES = [
    lambda n: n.is_a("blockquote", "gmail_quote"),
    lambda n: n.is_a("div", "gmail_quote"),
    lambda n: n.tag == "blockquote" and n.parent is not None and n.parent.is_a(cls="gmail_extra"),
    lambda n: n.tag == "blockquote" and n.get("type").lower() == "cite",
    lambda n: n.is_a("div", "moz-cite-prefix"),
]
_TAILS = [
    lambda n: n.get("id") == "appendonsend",
    lambda n: n.tag == "hr" and n.get("id") == "stopSpelling",
    lambda n: n.get("id") == "divRplyFwdMsg",
]
_OLD = lambda n: n.tag == "blockquote" or n.is_a(cls="gmail_attr")


def _lines(node: Node) -> str:
    out = []
    for c in node.children:
        out.append(c.text if c.tag is None else "\n" if c.tag == "br" else _lines(c) + ("\n" if c.tag in _LINE_ENDS else ""))
    return "".join(out)


def possible_reply(node: Node) -> bool:
    """Whether an answer may stand among the quoted lines or beside the nested quotes of this element."""
    lines = [x for x in map(strip, re.split(r"\r?\n", _lines(node))) if x]
    prose = " ".join(x for x in lines if not x.startswith(">") and not _INTRO.match(x))
    if units(prose) > INLINE_REPLY and any(x.startswith(">") for x in lines):
        return True
    if not (node.is_a("div", "gmail_quote") or node.is_a(cls="gmail_extra")):
        return False
    rest = node.copy()
    for n in rest.find_all(lambda n: _OLD(n) or n.is_a("div", "gmail_quote")):
        n.remove()
    return units(strip(squeeze(rest.content()))) > INLINE_REPLY


def strip_quotes(root: Node) -> tuple[int, int]:
    """Cut signatures and quoted history out of ``root``; returns how many elements went and how many quotes stayed."""
    removed = preserved = 0
    for n in root.find_all(_SIGNATURE):
        n.remove()
        removed += 1
    for kind in _QUOTES:
        for n in root.find_all(kind):
            if not n.inside(root):
                continue
            if possible_reply(n):
                preserved += 1
                old = n.find_all(_OLD)
                removed += len(old)
            else:
                old = [n]
                removed += 1
            for x in old:
                x.remove()
    for kind in _TAILS:
        first = root.find(kind)
        if first is not None:
            after = first.parent.children
            after = after[next(k for k, c in enumerate(after) if c is first) :]
            removed += len(after)
            for n in after:
                n.remove()
    return removed, preserved
