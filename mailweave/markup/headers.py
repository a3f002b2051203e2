"""Senders, dates and recipients in the header rows of a printed message."""

from __future__ import annotations

import re

from mailweave.functions.policy import LABELS
from mailweave.markup.space import strip
from mailweave.markup.tree import Node

EMAIL = re.compile(r"[A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Z0-9-]+(?:\.[A-Z0-9-]+)+", re.I)
_LABELS = [(kind, re.compile(rf"(?:{words})\s*[:：]\s*", re.I)) for kind, words in LABELS.items()]
_IGNORED = re.compile(r"reply-to\s*[:：]", re.I)
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"')
_ANGLE = re.compile(r"(.*?)[<〈]\s*([^>〉]+?)\s*[>〉]\s*\Z")
_LINE_ENDS = {"div", "p", "tr", "table", "li", "td", "th"}


def header_text(node: Node | None) -> str:
    """Text with a new line for each line break and after each block."""
    out = []
    for c in node.children if node else ():
        out.append(c.text if c.tag is None else "\n" if c.tag == "br" else header_text(c) + ("\n" if c.tag in _LINE_ENDS else ""))
    return "".join(out)


def address(raw: str) -> dict[str, str]:
    """Name and address of one entry; the address stands for a missing name."""
    raw = strip(raw)
    angle = _ANGLE.match(raw)
    found = EMAIL.search(angle.group(2) if angle else raw)
    email = found.group() if found else ""
    name = angle.group(1) if angle else raw.replace(email, "", 1)
    name = strip(name)
    if len(name) > 1 and name[0] == name[-1] == '"':
        name = name[1:-1]
    return {"name": strip(name.replace('\\"', '"')) or email, "email": email}


def _entries(value: str) -> tuple[list[str], bool]:
    """The text between commas and semicolons outside quotes and angles, and whether all of those are closed."""
    entries, begin, angles, quoted, at = [], 0, 0, False, 0
    while at < len(value):
        c = value[at]
        if quoted and c == "\\":
            at += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            if c in "<〈":
                angles += 1
            elif c in ">〉":
                angles = max(0, angles - 1)
            elif c in ",;" and not angles:
                entries.append(value[begin:at])
                begin = at + 1
        at += 1
    return [*entries, value[begin:]], not quoted and not angles


def address_list(value: str | None) -> tuple[list[dict[str, str]], bool]:
    """All entries of a list, and whether every one of them was understood."""
    entries, complete = _entries(value or "")
    items = []
    for raw in filter(None, map(strip, entries)):
        own = address(raw)
        several = len(EMAIL.findall(_QUOTED.sub("", raw))) > 1
        if several or ("@" in raw and not own["email"]) or not own["name"]:
            complete = False
        if own["name"]:
            items.append(own)
    return items, complete


def recipient_line(line: str) -> tuple[str, str] | None:
    """(to, cc or bcc; the list) of a labelled line."""
    for kind, label in _LABELS:
        found = label.match(line)
        if found:
            return kind, line[found.end() :]
    return None


def header(rows: list[Node]) -> dict:
    """Sender, recipients, displayed date, and what is missing; the last of several rows is the body."""
    own = rows[:-1] if len(rows) > 1 else rows
    first = own[0] if own else None
    out: dict = {"to": [], "cc": [], "bcc": []}
    understood, labelled = True, False
    lines = re.split(r"\r?\n", "\n".join(map(header_text, own[1:])))
    for line in filter(None, map(strip, lines)):
        found = recipient_line(line)
        if found is None:
            understood &= bool(_IGNORED.match(line)) or not EMAIL.search(line)
            continue
        items, complete = address_list(found[1])
        labelled = True
        understood &= complete and bool(items)
        out[found[0]] += items
    bold = first.find(lambda n: n.tag == "b") if first else None
    name = strip(bold.content()) if bold else ""
    email = EMAIL.search(header_text(first))
    email = email.group() if email else ""
    cells = first.elements("td", "th") if first else []
    date = strip(header_text(cells[-1])) if len(cells) > 1 else ""
    found = {"sender": bool(name or email), "date": bool(date), "recipients": labelled and understood}
    return {**out, "from": {"name": name or email, "email": email}, "date_raw": date, "issues": [k for k, ok in found.items() if not ok]}
