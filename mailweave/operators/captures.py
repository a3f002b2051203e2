"""Captured pages as threads: one Arrow pass parses each page once into one row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from mailweave.functions import subjects, text
from mailweave.markup import headers
from mailweave.markup.markdown import markdown
from mailweave.markup.quotes import strip_quotes
from mailweave.markup.space import strip
from mailweave.markup.tree import Node, parse, table_rows
from mailweave.operators import attachments, trimming

_PERSON = "struct<name: string, email: string>"
_FIELDS = f"""status string, title string, source string, quoted_trimmed boolean, messages_complete boolean, headers_complete boolean, attachments_complete boolean,
expected int, messages array<struct<n: int, from: {_PERSON}, to: array<{_PERSON}>, cc: array<{_PERSON}>, bcc: array<{_PERSON}>, date_raw: string, body: string>>,
attachments array<struct<{", ".join(x.replace(" ", ": ", 1) for x in attachments.ITEM.split(", "))}>>, warnings array<struct<code: string, message: string>>"""
_REPLY_KEPT = ("INLINE_REPLY_PRESERVED", "A quoted block was retained because it may contain an inline reply.")


def _is_message(n: Node) -> bool:
    return n.is_a("table", "message") and (n.parent is None or n.parent.closest(lambda x: x.is_a("table", "message")) is None)


def _body(cell: Node) -> tuple[str, bool, bool, int]:
    """Markdown of a body without quoted history; whether some was cut, whether the page elided it, and quotes kept."""
    removed, kept = strip_quotes(cell)
    body, trimmed, elided = trimming.trim(markdown(cell))
    return body, bool(removed) or trimmed, elided, kept


def print_view(html: str | None, thread_id: str, account: str, subject: str | None) -> dict:
    """A print view as a thread; its status is ok, empty, or mismatch if its title names another conversation."""
    root = parse(html)
    tables = root.find_all(_is_message)
    found = root.find(lambda n: n.tag == "title")
    title = strip(re.sub(r"\s+", " ", found.content())) if found else ""
    out: dict = {"status": "empty", "title": title, "messages": [], "attachments": [], "warnings": [], "expected": len(tables), "quoted_trimmed": False}
    if tables and not subjects.title_matches(title, subject):
        return {**out, "status": "mismatch"}
    warn = lambda code, message: out["warnings"].append({"code": code, "message": message})
    headers_fine = attachments_fine = True
    kept = 0
    for n, table in enumerate(tables, 1):
        rows = table_rows(table)
        if len(rows) < 2:
            headers_fine = attachments_fine = False
            warn("MESSAGE_SKIPPED", f"Message candidate {n} used an unrecognized layout and was not copied.")
            continue
        head = headers.header(rows)
        if head["issues"]:
            headers_fine = False
            warn("HEADER_INCOMPLETE", f"Message {n} is missing parsed {', '.join(head['issues'])} information.")
        items, issues = attachments.printed(rows[-1], thread_id, account)
        if issues:
            attachments_fine = False
            warn("ATTACHMENT_INCOMPLETE", f"Message {n}: {'; '.join(issues)}.")
        out["attachments"] += [{**x, "message_n": n} for x in items]
        body, cut, elided, quotes = _body(rows[-1])
        out["quoted_trimmed"] |= cut
        kept += quotes
        if elided:
            warn("BODY_ELIDED_BY_GMAIL", f"Message {n}: Gmail rendered this body as an elision placeholder, so its content was never in the print view and is not reported here.")
        out["messages"].append({"n": n, **{k: head[k] for k in ("from", "to", "cc", "bcc", "date_raw")}, "body": body})
    if kept:
        warn(*_REPLY_KEPT)
    if not out["messages"]:
        return out
    fine = (len(out["messages"]) == len(tables), headers_fine, attachments_fine)
    return {**out, "status": "ok", "source": "print-view" if all(fine) else "print-view-partial", **dict(zip(("messages_complete", "headers_complete", "attachments_complete"), fine, strict=True))}


def visible_page(html: str | None, reason: str | None = None) -> dict:
    """What a live page shows of a thread; never complete."""
    messages, trimmed, kept = [], False, 0
    root = parse(html)
    for node in root.find_all(lambda n: n.is_a("div", "adn")):
        cell = node.find(lambda n: n.is_a("div", "a3s"))
        if cell is None:
            continue
        body, cut, _, quotes = _body(cell.copy())
        trimmed, kept = trimmed or cut, kept + quotes
        who, when = (node.find(lambda n, c=c: n.is_a("span", c)) for c in ("gD", "g3"))
        own = lambda n, name: strip((n.get(name) or (n.content() if name != "email" else "")) if n else "")
        messages.append({"n": len(messages) + 1, "from": {"name": own(who, "name"), "email": own(who, "email")}, "to": [], "cc": [], "bcc": [], "date_raw": own(when, "title"), "body": body})
    reason = reason or "Gmail's complete print view was unavailable. Collapsed messages and headers may be missing."
    warnings = [("VISIBLE_PAGE_FALLBACK", reason), *([_REPLY_KEPT] if kept else [])]
    return {
        "status": "ok" if messages else "empty", "title": "", "source": "visible-page-partial", "quoted_trimmed": trimmed, "messages_complete": False, "headers_complete": False, "attachments_complete": False,
        "messages": messages, "attachments": [], "warnings": [{"code": c, "message": m} for c, m in warnings],
    }


def thread(html: str | None, live: str | None, thread_id: str | None, account: str | None, subject: str | None) -> dict:
    """The print view, completed by the live page's attachments; the live page alone where there is no print view."""
    thread_id, account = thread_id or "", account or ""
    out = print_view(html, thread_id, account, subject)
    if out["status"] == "empty" and live:
        out = visible_page(live)
    if out["status"] != "ok":
        return out
    if live:
        shown, more = attachments.chips(parse(live), thread_id, account)
        items, extra = attachments.merged(out["attachments"], shown, thread_id, account)
        out["attachments"] = items
        out["attachments_complete"] = out["attachments_complete"] and not more and not extra
        if more:
            out["warnings"].append({"code": "ATTACHMENT_SCAN_LIMIT", "message": f"Live attachment discovery stopped at {attachments.MOST_CHIPS} candidates."})
        if extra:
            told = f"{extra} attachment(s) were visible on the Gmail page but missing from the print-view parse; their message attribution is unknown."
            out["warnings"].append({"code": "ATTACHMENT_ATTRIBUTION_UNKNOWN", "message": told})
    out["attachments"] = attachments.normalised(out["attachments"], thread_id, account)
    return out


def parsed(captures: DataFrame) -> DataFrame:
    """captures(thread_id, account_index, subject, timezone, html, live_html) with a column ``thread``.

    A page that can't be read at all is an empty thread. Other columns must not be named ``thread``.
    """
    kind = StructType.fromDDL(_FIELDS)
    arrow = to_arrow_type(kind)
    needs = ["html", "live_html", "thread_id", "account_index", "subject"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in needs), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([thread(*r) for r in rows], arrow)], [*batch.schema.names, "thread"])

    return captures.mapInArrow(run, StructType([*captures.schema.fields]).add("thread", kind))


def messages(threads: DataFrame) -> DataFrame:
    """A row for each message of parsed threads, with ISO dates in the zone of the capture."""
    rows = threads.where("thread.status = 'ok'").select("thread_id", F.coalesce("timezone", F.lit("UTC")).alias("zone"), F.explode("thread.messages").alias("m"))
    return rows.select("thread_id", "m.n", "m.from.name", "m.from.email", "m.to", "m.cc", "m.bcc", text.iso_time(F.col("m.date_raw"), F.col("zone")).alias("date"), F.col("m.date_raw").alias("local"), "m.body")


def items(threads: DataFrame) -> DataFrame:
    """A row for each attachment of parsed threads, in order."""
    rows = threads.where("thread.status = 'ok'").select("thread_id", "subject", F.posexplode("thread.attachments").alias("ord", "a"))
    return rows.select("thread_id", "subject", "ord", "a.*")


def login_page(url: Column, html: Column) -> Column:
    """Whether a response is a sign-in page instead of a capture."""
    moved = F.coalesce(url, F.lit("")).rlike(r"(?i)accounts\.google\.com|ServiceLogin")
    return moved | F.coalesce(html, F.lit("")).rlike(r"(?iu)<title>[^<]*(?:sign in|anmelden|connexion|iniciar sesión)[^<]*</title>")


def same_identity(thread_id: Column, account: Column, subject: Column, expected_id: Column, expected_account: Column, expected_subject: Column) -> Column:
    """Whether a capture is the conversation that was asked for; anything missing is not."""
    return F.coalesce((thread_id == expected_id) & (account == expected_account), F.lit(False)) & text.same_subject(subject, expected_subject)
