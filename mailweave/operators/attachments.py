"""Attachments of captured threads: discovery, merging, names, inline text and status."""

from __future__ import annotations

import codecs
import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailweave.functions import text, urls
from mailweave.functions.policy import ROOT
from mailweave.markup.space import head, strip, units
from mailweave.markup.tree import Node

#: Limits of names, live candidates, inline text and downloads.
LONG_NAME, SHORT_NAME, MOST_CHIPS = 500, 200, 500
FILE_LIMIT, THREAD_LIMIT, DOWNLOAD_LIMIT = 100 << 10, 300 << 10, 25 << 20
_SIZE = re.compile(r"(?<![A-Za-z0-9_])([0-9]+(?:[.,][0-9]+)?)\s*[KMG]B?(?![A-Za-z0-9_])", re.I)


# Discovery in print views


def _container(node: Node, scope: Node) -> Node | None:
    """The table around an attachment, if it is not the message itself."""
    table, message = node.closest(lambda n: n.tag == "table"), scope.closest(lambda n: n.is_a("table", "message"))
    return table if table is not message else None


def _name(node: Node) -> str:
    bold = lambda n: n.find(lambda x: x.tag == "b") if n else None
    around = [node, node.closest(lambda n: n.tag == "tr"), node.closest(lambda n: n.tag == "table")]
    shown = [strip(b.content()) for b in map(bold, around) if b] + [strip(node.get("title"))]
    own = strip(node.content())
    return head(next(filter(None, shown), own if units(own) <= SHORT_NAME else ""), LONG_NAME)


def _size(node: Node) -> str | None:
    for tag in ("tr", "table"):
        around = node.closest(lambda n, tag=tag: n.tag == tag)
        found = _SIZE.search(around.content()) if around else None
        if found:
            return strip(found.group())
    return None


def printed(scope: Node, thread_id: str, account: str) -> tuple[list[dict], list[str]]:
    """Attachments of a printed body, whose elements are cut out, and what could not be verified."""
    items: list[dict] = []
    issues: list[str] = []
    done: list[Node] = []
    refused: list[Node] = []

    def add(node: Node, url: str | None, container: Node | None) -> str:
        name = _name(node)
        if name:
            items.append({"name": name, "size": _size(node), "url": url, "source": "print-view"})
            if container:
                container.remove()
        return name

    for link in scope.find_all(lambda n: n.tag == "a" and "href" in n.attrs):
        url, container = urls.attachment_url(link.get("href"), thread_id, account), _container(link, scope)
        if url is None:
            refused += [container] if container else []
        elif not add(link, url, container):
            issues.append("attachment link without a filename")
        elif container:
            done.append(container)
    for icon in scope.find_all(lambda n: n.tag == "img" and "/icons/mail/" in n.get("src")):
        container = _container(icon, scope)
        if not urls.interface_icon(icon.get("src")) or any(container is n for n in done if container):
            continue
        name = add(icon, None, container)
        rejected = any(container is n for n in refused if container)
        issues.append("attachment icon without a filename" if not name else f"download link rejected by URL policy for {name}" if rejected else f"no download link for {name}")
    return items, issues


# Discovery in live pages


def download_parts(raw: str | None) -> dict[str, str] | None:
    """type, name and url of a ``type:name:url`` value; the url begins at its rightmost marker."""
    value = raw or ""
    first = value.find(":")
    at = max(value.rfind(m) for m in (":https://", ":http://", ":/mail/"))
    if first < 1 or at <= first:
        return None
    name = value[first + 1 : at]
    if not re.search("%(?![0-9A-Fa-f]{2})", name):
        try:
            name = unquote_to_bytes(name).decode()
        except UnicodeDecodeError:
            pass
    return {"type": value[:first], "name": name, "url": value[at + 1 :]}


def chips(root: Node, thread_id: str, account: str) -> tuple[list[dict], bool]:
    """Attachments that a live page shows beside its messages, one for each, and whether there were too many."""
    chip = lambda n: n.is_a("span", "aV3") or "download_url" in n.attrs or (n.tag == "span" and "title" in n.attrs and n.closest(lambda x: x.is_a("div", "aQA")))
    carries = lambda n: "download_url" in n.attrs
    file_name = lambda n: n.is_a("span", "aV3")
    found: list[dict] = []
    more = False
    for node in root.find_all(chip):
        if len(found) >= MOST_CHIPS:
            more = True
            break
        if node.closest(lambda n: n.is_a("div", "a3s")):
            continue  # a body's own markup, not the page's
        carrier = node.closest(carries) or node.find(carries) or node.closest(lambda n: n.tag == "a" and "href" in n.attrs)
        raw = carrier.get("download_url") if carrier else ""
        parts = download_parts(raw)
        href = (carrier.get("href") if carrier else "") or (parts["url"] if parts else "")
        if not raw and not file_name(node) and not node.find(file_name) and href and not urls.points_home(href):
            continue
        name = strip((parts["name"] if parts else "") or node.get("title") or node.content())
        if name:
            found.append({"name": name, "download_url": raw or None, "href": href or None, "message_n": None, "source": "live-page"})
    linked = {name_key(x["name"]) for x in found if x["href"]}
    out: dict[str, dict] = {}
    for x in found:
        key, href = name_key(x["name"]), x["href"]
        if href:
            out.setdefault(urls.attachment_url(href, thread_id, account) or urls.capability_key(href) or f"rejected:{key}:{href}", x)
        elif key not in linked:
            out.setdefault(f"no-link:{key}", x)
    return list(out.values()), more


# Names


def safe_name(raw: str | None, fallback: str = "attachment") -> str:
    """A file name without separators, controls or device names, of at most 100 UTF-16 units, that keeps its extension."""
    n = unicodedata.normalize("NFC", raw or "")
    n = re.sub("[\x00-\x1f\x7f]", "", n).replace("/", "_").replace("\\", "_")
    n = "".join(c if c in "._ ()-" or unicodedata.category(c)[0] in "LN" else "_" for c in n)
    for pattern, to in ((r"\.{2,}", "."), (r"\A[. ]+", ""), ("_{2,}", "_"), (" {2,}", " "), (r" +\.", "."), (r"[. ]+\Z", "")):
        n = re.sub(pattern, to, n)
    n = n or fallback
    if re.match(r"(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|\Z)", n, re.I):
        n = "_" + n
    if units(n) > 100:
        stem, dot, ext = n.rpartition(".")
        ext = dot + ext if stem and 1 <= len(ext) <= 8 and all(unicodedata.category(c)[0] in "LN" for c in ext) else ""
        n = head(n, 100 - units(ext)).strip() + ext
    return n


def folded(name: str) -> str:
    return unicodedata.normalize("NFKC", name).lower()


def name_key(name: str | None) -> str:
    return folded(safe_name(name or "attachment"))


class Names:
    """Names in use; one taken before, in any case or form, gets the least free number."""

    def __init__(self) -> None:
        self.used: set[str] = set()
        self.next: dict[str, int] = {}

    def take(self, name: str) -> str:
        found = re.search(r"\.[A-Za-z0-9]{1,8}\Z", name)
        stem, ext = (name[: found.start()], found.group()) if found else (name, "")
        k, free = self.next.get(folded(name), 1), name
        while folded(free := name if k == 1 else f"{stem} ({k}){ext}") in self.used:
            k += 1
        self.next[folded(name)] = k
        self.used.add(folded(free))
        return free


# Merging


def links_of(item: dict) -> list[str]:
    parts = download_parts(item.get("download_url"))
    return list(dict.fromkeys(filter(None, (parts and parts["url"], item.get("url"), item.get("href")))))


def verified(item: dict, thread_id: str, account: str) -> str | None:
    return next(filter(None, (urls.attachment_url(x, thread_id, account) for x in links_of(item))), None)


def merged(primary: list[dict], more: list[dict], thread_id: str, account: str) -> tuple[list[dict], int]:
    """All of ``primary``, completed from ``more`` one to one, and those of ``more`` that stand for none, with their number.

    In order, each one meets the first not yet met item of its address, else of its capability, else of its name.
    """
    out = [dict(x) for x in primary]
    known: dict[tuple[str, str], list[dict]] = {}
    met: set[int] = set()

    def keys(item: dict, url: str | None, looked_up: bool) -> list[tuple[str, str]]:
        link = url or (item.get("href") or item.get("url") if looked_up else None)
        capability = urls.capability_key(link) if link else None
        return [("url", url or ""), ("capability", capability or ""), ("name", name_key(item.get("name")))]

    def enter(item: dict) -> None:
        for kind, key in keys(item, verified(item, thread_id, account), False):
            # Only the first item of an address or capability can be met by it.
            if key and (kind == "name" or (kind, key) not in known):
                known.setdefault((kind, key), []).append(item)

    for x in out:
        enter(x)
    extra = 0
    for x in map(dict, more):
        url = verified(x, thread_id, account)
        pool = [y for k in keys(x, url, True) if k[1] for y in known.get(k, ()) if id(y) not in met]
        if not pool:
            out.append(x)
            enter(x)
            extra += 1
            continue
        own = pool[0]
        met.add(id(own))
        if own.get("message_n") is None:
            own["message_n"] = x.get("message_n")
        own["size"] = own.get("size") or x.get("size")
        if not verified(own, thread_id, account) and (url or not own.get("href")):
            own["href"] = url or next(iter(links_of(x)), None) or own.get("href")
    return out, extra


def normalised(items: list[dict], thread_id: str, account: str) -> list[dict]:
    """One entry per verified address with safe, distinct names; the first wins, later ones fill what it lacks."""
    out: list[dict] = []
    by_url: dict[str, dict] = {}
    names = Names()
    for x in items:
        url, parts = verified(x, thread_id, account), download_parts(x.get("download_url")) or {}
        own = by_url.get(url) if url else None
        if own is not None:
            own["message_n"] = x.get("message_n") if own["message_n"] is None else own["message_n"]
            own["size"] = own["size"] or x.get("size") or None
            continue
        raw = parts.get("name") or x.get("name") or "attachment"
        name = safe_name(raw)
        own = {
            "name": name, "original_name": raw, "target_name": names.take(name), "declared_type": parts.get("type") or x.get("type"), "size": x.get("size") or None,
            "url": url, "rejected_url": not url and bool(links_of(x)), "message_n": x.get("message_n"), "source": x.get("source") or "unknown",
        }
        out.append(own)
        if url:
            by_url[url] = own
    return out


ITEM = "name string, original_name string, target_name string, declared_type string, size string, url string, rejected_url boolean, message_n int, source string"


# Inline text

#: What web labels of Latin text mean.
_LABELS = {"iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252"}


def decoded(content: bytes, content_type: str | None) -> str:
    """Text by byte-order mark, else by the declared charset, else as UTF-8; what can't be read becomes U+FFFD."""
    for mark, name in ((codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF8, "utf-8")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    found = re.search(r"""(?<![A-Za-z0-9_])charset\s*=\s*["']?([^;"'\s]+)""", content_type or "", re.I)
    label = found.group(1).lower() if found else "utf-8"
    try:
        return content.decode(_LABELS.get(label, label), "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


def _decoded(content: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else decoded(bytes(c), k) for c, k in zip(content, kind, strict=True)], dtype=object)


decoded_of = F.pandas_udf(_decoded, StringType())


def target_path(subject: Column, name: Column) -> Column:
    return F.concat(F.lit(f"{ROOT}/"), text.slug(subject), F.lit("/"), name)


def budgeted(items: DataFrame, thread: str, order: str, size: str, eligible: Column | None = None) -> DataFrame:
    """Adds budget_left and inlined_bytes: eligible files share a budget per thread, in order, and have a limit each.

    Files that are not eligible, or whose size is null, get and use up nothing.
    """
    before = Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fits = F.col(size).isNotNull() & (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False)))
    want = F.when(fits, F.least(F.col(size), F.lit(FILE_LIMIT))).otherwise(0)
    left = F.greatest(F.lit(0), F.lit(THREAD_LIMIT) - F.coalesce(F.sum(want).over(before), F.lit(0))).cast("long")
    out = items.withColumn("budget_left", left)
    return out.withColumn("inlined_bytes", F.when(fits & (F.col("budget_left") > 0), F.least(want, F.col("budget_left")).cast("long")))


def collected(items: DataFrame, files: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Inline text and status of every attachment.

    items: thread_id, ord, subject and the fields of ITEM. files(thread_id, url, content_type, content): what could be
    read, a row for each. results(thread_id, url, ok, path, status, error): outcomes of downloads, or None if nothing is saved.
    """
    name, url = F.col("name"), F.col("url")
    known = items.withColumn("inlineable", text.inlineable(name)).withColumn("size_bytes", text.size_bytes(F.col("size"))).withColumn("type", text.clean_type(F.col("declared_type"), name))
    known = known.withColumn("path", target_path(F.col("subject"), F.col("target_name")))
    sizes = files.select("thread_id", "url", F.octet_length("content").cast("long").alias("length"))
    asked = F.col("inlineable") & url.isNotNull()
    dealt = budgeted(known.join(sizes, ["thread_id", "url"], "left"), "thread_id", "ord", "length", asked)
    # Contents are cut before they meet their rows, and only where something is inlined.
    text_of = files.join(dealt.where("inlined_bytes IS NOT NULL").select("thread_id", "url", "inlined_bytes"), ["thread_id", "url"])
    text_of = text_of.select("thread_id", "url", decoded_of(F.expr("substring(content, 1, cast(inlined_bytes as int))"), F.col("content_type")).alias("text"))
    out = dealt.join(text_of, ["thread_id", "url"], "left")
    truncated = F.coalesce(F.col("inlined_bytes") < F.col("length"), F.lit(False))
    note = F.concat(F.lit("\n[truncated after "), text.size_text(F.col("inlined_bytes")), F.lit(" of "), text.size_text(F.col("length")), F.lit("]"))
    inlined = F.col("inlined_bytes").isNotNull()
    out = out.withColumn("truncated", truncated & inlined).withColumn("content", F.when(inlined, F.concat("text", F.when(truncated, note).otherwise(""))))
    inline_status = F.when(asked & ~inlined, F.when(F.col("budget_left") > 0, "could not be read").otherwise("not inlined: thread text limit reached"))
    out = out.withColumn("inline_status", inline_status)
    if results is None:
        done = F.when(inlined, F.when(F.col("truncated"), "inlined (truncated)").otherwise("inlined")).otherwise(F.coalesce("inline_status", F.lit("not downloaded (use Copy + save files)")))
        out = out.withColumn("saved", F.lit(False)).withColumn("skipped", F.lit(False)).withColumn("path", F.lit(None).cast("string"))
    else:
        answers = results.select("thread_id", "url", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("path").alias("saved_path"), F.col("status").alias("saved_status"), "error")
        out = out.join(answers, ["thread_id", "url"], "left")
        skipped = url.isNotNull() & F.coalesce(F.col("size_bytes") > DOWNLOAD_LIMIT, F.lit(False))
        saved = url.isNotNull() & ~skipped & F.coalesce("ok", F.lit(False))
        shown = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(other)
        done = F.when(skipped, f"not downloaded: exceeds {DOWNLOAD_LIMIT / (1 << 20):.1f} MB limit").when(saved, shown("saved_status", "download started")).otherwise(shown("error", "download failed to start"))
        out = out.withColumn("saved", saved).withColumn("skipped", skipped).withColumn("path", F.when(saved, shown("saved_path", F.col("path"))))
    status = F.when(F.col("rejected_url"), "unsafe download link rejected").when(url.isNull(), "no Gmail download link found").otherwise(done)
    names = ["thread_id", "ord", "name", "type", "size", "size_bytes", "message_n", "url", "rejected_url", "content", "inlined_bytes", "truncated", "path", "inline_status", "saved", "skipped"]
    return out.select(*names, status.alias("status"), F.lit(results is not None).alias("saving"))


def counters(done: DataFrame) -> DataFrame:
    """Ten counters of each thread's collected attachments."""
    tried = F.col("url").isNotNull() & F.col("saving")
    kinds = {
        "total": F.lit(True), "inlined": F.col("content").isNotNull(), "inline_failed": F.col("inline_status") == "could not be read", "inline_skipped": F.col("inline_status").startswith("not inlined"),
        "inline_truncated": F.col("truncated"), "download_started": F.col("saved"), "download_failed": tried & ~F.col("saved") & ~F.col("skipped"), "skipped": F.col("skipped"),
        "unsafe": F.col("rejected_url"), "no_link": F.col("url").isNull() & ~F.col("rejected_url"),
    }
    return done.groupBy("thread_id").agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in kinds.items()))
