"""Captures without what they say: names, numbers, addresses and links replaced, structure kept."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from mailweave.functions import urls
from mailweave.markup.headers import EMAIL
from mailweave.markup.space import strip, units
from mailweave.markup.tree import VOID, Node, parse

# Words that stay as they are, in natural order by kind.
KEPT = set(
    "re fwd fw aw wg on wrote to cc bcc from sent subject at am pm schrieb écrit 发件人 到 收件人 日期 主题 "
    "attachment attachments quoted text hidden message original forwarded "
    "jan feb mar apr may jun jul aug sep sept oct nov dec "
    "january february march april june july august september october november december "
    "mon tue tues wed thu thur thurs fri sat sun monday tuesday wednesday thursday friday saturday sunday".split()
)
#: Stand-ins for words; any list of twenty lower-case words will do.
WORDS = "amber birch cedar delta ember fable grove harbor indigo juniper kettle lantern meadow nickel orchard pebble quartz river saddle timber".split()
# Elements that act or load, ids that mark quoted history, and attributes that load or speak.
ACTIVE = {"script", "style", "iframe", "frame", "object", "embed", "template", "base", "link", "form", "input", "button", "meta"}
MARKERS = {"appendonsend", "stopSpelling", "divRplyFwdMsg"}
LOADING = re.compile(r"(?:href|src|url|uri|action|background|poster|manifest)\Z")
DROPPED = {"style", "ping", "srcset", "poster", "action", "formaction", "background", "cite", "manifest", "profile", "longdesc"}
SPOKEN = ("title", "name", "email", "alt", "value", "placeholder")
FORBIDDEN = [
    r"(?i)(?<![a-z0-9_])javascript:",
    r"(?i)(?<![a-z0-9_])on[a-z]+\s*=",
    r"(?i)<(?:script|iframe|object|embed|style|link|base)(?![a-z0-9_])",
    r"(?i)https?://(?!mail\.google\.com/|(?:ssl\.)?gstatic\.com/|example\.com/)",
]
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_NUMBERS = [re.compile(r"(?<!\w)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w)"), re.compile("\\+?[0-9][0-9\u00a0 ().-]{6,}[0-9]"), re.compile("[0-9]{5,}")]
_ICON = re.compile(r"https://(?:ssl\.)?gstatic\.com/(?:ui/v1/)?icons/mail/", re.I)
_PRODUCT = re.compile(r"\AGmail\s*[-–—]\s*|\s*[-–—]\s*Gmail\Z", re.I)


def _replaced(form: re.Pattern, stand_in: Callable[[str, int], str], text: str) -> str:
    """``text`` with a stand-in for each match and its place in UTF-16 units; the places before are counted once in all."""
    wide = not text.isascii() and max(text) > "\uffff"
    last = extra = 0

    def new(found: re.Match) -> str:
        nonlocal last, extra
        if wide:
            extra += sum(c > "\uffff" for c in text[last : found.start()])
            last = found.start()
        return stand_in(found.group(), found.start() + extra)

    return form.sub(new, text)


class Redactor:
    """Replacements of one capture; equal originals get equal stand-ins, numbered as they come."""

    def __init__(self) -> None:
        self.people: dict[str, int] = {}
        self.files: dict[str, int] = {}
        self.links: dict[str, int] = {}

    @staticmethod
    def _number(known: dict[str, int], key: str) -> int:
        return known.setdefault(key, len(known) + 1)

    def person(self, address: str) -> str:
        return f"person{self._number(self.people, address.lower())}@example.com"

    def file(self, name: str) -> str:
        ext = re.search(r"\.[A-Za-z0-9]{1,8}\Z", name)
        return f"document-{self._number(self.files, name)}{ext.group() if ext else ''}"

    def attachment(self, link: str) -> str:
        return f"/mail/u/0/?view=att&th=THREAD_REAL&attid=redacted-{self._number(self.links, link)}&disp=safe"

    @staticmethod
    def _word(word: str, at: int) -> str:
        if word.lower() in KEPT:
            return word
        new = WORDS[(units(word) * 7 + at) % len(WORDS)]
        if not re.search("[A-Za-z]", word):
            return new
        return new.upper() if word == word.upper() else new.capitalize() if word[0] == word[0].upper() else new

    @staticmethod
    def _digits(run: str, at: int) -> str:
        if sum(c.isdigit() for c in run) < 5:
            return run
        n = iter(range(len(run)))
        return re.sub("[0-9]", lambda _: str((len(run) * 7 + at + next(n) * 3) % 10), run)

    def text(self, value: str) -> str:
        """Addresses, words and long numbers replaced; runs of fewer than five digits stay."""
        pieces, end = [], 0
        for found in EMAIL.finditer(value) if "@" in value else ():
            pieces += [value[end : found.start()], self.person(found.group())]
            end = found.end()
        pieces.append(value[end:])
        for k in range(0, len(pieces), 2):
            out = _replaced(_LETTERS, self._word, pieces[k])
            for form in _NUMBERS:
                out = _replaced(form, self._digits, out)
            pieces[k] = out
        return "".join(pieces)

    def element(self, node: Node) -> bool:
        """Replace an element's attributes; returns whether its text has been replaced as a whole."""
        kept = {}
        for name, value in node.attrs.items():
            own = name == "download_url" or (node.tag, name) in (("a", "href"), ("img", "src"))
            if not (name.startswith(("on", "data-")) or name in DROPPED or (LOADING.search(name) or "href" in name) and not own):
                kept[name] = value
        if node.tag == "a":
            href = node.get("href")
            mail = re.match("mailto:", href, re.I)
            kept["href"] = f"mailto:{self.person(href[7:])}" if mail else self.attachment(href) if self._is_attachment(href) else "https://example.com/link"
        if node.tag == "img":
            icon = _ICON.match(node.get("src"))
            kept["src"] = node.get("src").split("?")[0].split("#")[0] if icon else "https://example.com/image.png"
            kept.update({"alt": "image"} if "alt" in kept else {})
        if "download_url" in kept:
            raw = kept.pop("download_url")
            at = max(raw.rfind(m) for m in (":https://", ":http://", ":/mail/"))
            if 0 < raw.find(":") < at:
                kind, _, name = raw[:at].partition(":")
                kind = re.sub(r"[^A-Za-z0-9!#$&^_.+/-]", "", kind) or "application/octet-stream"
                kept["download_url"] = f"{kind}:{self.file(name)}:{self.attachment(raw[at + 1 :])}"
        for name in SPOKEN:
            if kept.get(name) and not (node.tag == "img" and name == "alt"):
                kept[name] = self.text(kept[name])
        for name in kept:
            if name.startswith("aria-"):
                kept[name] = "redacted"
            elif name == "id" and kept[name] not in MARKERS:
                kept[name] = "redacted-id"
        node.attrs = kept
        shown = strip(node.content()) if node.tag == "b" else ""
        if not re.search(r"\.[A-Za-z0-9]{1,8}\Z", shown):
            return False
        node.children = []
        node.add(Node(None, text=self.file(shown)))
        return True

    @staticmethod
    def _is_attachment(link: str) -> bool:
        return urls.points_home(link) and urls.parse_url(link, urls._BASE).value("view") == "att"

    def tree(self, root: Node) -> None:
        for n in root.find_all(lambda n: n.tag in ACTIVE):
            n.remove()
        todo = list(root.children)
        while todo:
            node = todo.pop(0)
            if node.tag is None:
                node.text = self.text(node.text) if strip(node.text) else node.text
            elif node.tag == "title":
                subject = strip(_PRODUCT.sub("", strip(node.content()), count=1))
                node.children = []
                node.add(Node(None, text="Gmail - " + self.text(subject)))
            elif not self.element(node):
                todo = node.children + todo


def written(root: Node) -> str:
    """A tree as HTML."""
    out: list[str] = []
    todo: list[Node | str] = root.children[::-1]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag is None:
            out.append(escape(node.text, quote=False))
        else:
            out.append(f"<{node.tag}{''.join(f' {k}={chr(34)}{escape(v)}{chr(34)}' for k, v in node.attrs.items())}>")
            if node.tag not in VOID:
                todo += [f"</{node.tag}>", *node.children[::-1]]
    return "<!doctype html>\n" + "".join(out)


def redact(html: str | None) -> dict:
    """The redacted page, how many people and files it named, what a reviewer is told, and whether it is safe to keep."""
    root, own = parse(html), Redactor()
    own.tree(root)
    page = written(root)
    title = root.find(lambda n: n.tag == "title")
    message = lambda n: n.is_a("table", "message")
    tables = root.find_all(lambda n: message(n) and not n.parent.closest(message))
    held = root.find_all(lambda n: (n.tag == "a" and "view=att" in n.get("href")) or (n.tag == "img" and "/icons/mail/" in n.get("src")))
    around = {id(n.closest(lambda x: x.tag == "table") or n) for n in held}
    return {
        "html": page, "people": len(own.people), "files": len(own.files), "subject": strip(_PRODUCT.sub("", title.content(), count=1)) if title else "",
        "message_count": len(tables), "attachment_count": len(around), "safe": not any(re.search(p, page) for p in FORBIDDEN),
    }


_SHAPE = StructType([StructField("html", StringType()), *(StructField(c, IntegerType()) for c in ("people", "files")), StructField("subject", StringType()), *(StructField(c, IntegerType()) for c in ("message_count", "attachment_count")), StructField("safe", BooleanType())])


def redacted(c: Column) -> Column:
    """``redact`` as a struct column, a row at a time of an Arrow batch."""
    return F.pandas_udf(lambda s: pd.DataFrame([redact(x) for x in s], columns=_SHAPE.names), _SHAPE)(c)


def redacted_text(c: Column) -> Column:
    """Plain text with addresses, words and long numbers replaced; people are numbered per value."""
    return F.pandas_udf(lambda s: pd.Series([None if x is None else Redactor().text(x) for x in s], dtype=object), StringType())(c)


def sidecar(r: Column) -> Column:
    """What is kept beside a redacted capture until someone has reviewed it."""
    return F.struct(
        F.lit(1).alias("schema_version"), F.lit("redacted-live-gmail-print-view").alias("kind"), F.lit(False).alias("manually_reviewed"), r["subject"].alias("subject"), r["message_count"].alias("message_count"),
        r["attachment_count"].alias("attachment_count"), F.lit(None).cast("boolean").alias("expected_complete"), F.lit("Inspect the HTML, then set manuallyReviewed and expectedComplete.").alias("review_notes"),
    )


def verified(html: Column) -> Column:
    """The page, or an error where it still holds what a redacted capture must not."""
    bad = F.lit(False)
    for p in FORBIDDEN:
        bad = bad | html.rlike(p)
    return F.when(bad, F.raise_error(F.lit("redaction safety check failed"))).otherwise(html)
