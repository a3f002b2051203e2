"""Markdown of an HTML tree. Links and images are untrusted: unsafe targets are dropped and images only described."""

from __future__ import annotations

import re

from mailweave.functions import urls
from mailweave.markup.space import RUN, SPACES, squeeze, strip, strip_end
from mailweave.markup.tree import Node, parse, table_rows

# Elements without content, elements that end a line, and addresses of tracking images.
SKIPPED = {"script", "style", "head", "noscript", "meta", "link", "title", "button", "select"}
BLOCKS = {
    "address", "article", "aside", "div", "dl", "dd", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main",
    "nav", "p", "section", "tr",
}
TRACKERS = re.compile(r"email_open_log_pic|/open\.gif|utm_medium=email.*pixel", re.I)
_ESCAPES = {"\\": "%5C", "(": "%28", ")": "%29", "<": "%3C", ">": "%3E", '"': "%22", "'": "%27"}


def _fence(body: str, least: int) -> str:
    return "`" * max(least, 1 + max(map(len, re.findall("`+", body)), default=0))


class _Writer:
    """Renders nodes; ``depth`` counts lists around, ``cell`` says that a table cell is around."""

    def inner(self, node: Node, depth: int, cell: bool) -> str:
        out: list[str] = []
        fresh = False  # nothing but blanks since the last new line
        for child in node.children:
            piece = self.write(child, depth, cell)
            if not piece:
                continue
            if out and not fresh and child.tag in BLOCKS:
                out.append("\n")
            out.append(piece)
            rest = piece.rpartition("\n")
            fresh = (fresh or bool(rest[1])) and not rest[2].strip(" \t")
        return "".join(out)

    def write(self, node: Node, depth: int, cell: bool) -> str:
        if node.tag is None:
            return squeeze(node.text)
        if node.tag in SKIPPED:
            return ""
        special = getattr(self, f"on_{node.tag}", None)
        if special:
            return special(node, depth, cell)
        body = self.inner(node, depth, cell)
        return body + "\n" if node.tag in BLOCKS else body

    def on_br(self, node: Node, depth: int, cell: bool) -> str:
        return "\n"

    def on_hr(self, node: Node, depth: int, cell: bool) -> str:
        return "\n---\n"

    def _marked(self, mark: str, node: Node, depth: int, cell: bool) -> str:
        body = strip(self.inner(node, depth, cell))
        return body and f"{mark}{body}{mark}"

    def on_b(self, node: Node, depth: int, cell: bool) -> str:
        return self._marked("**", node, depth, cell)

    def on_i(self, node: Node, depth: int, cell: bool) -> str:
        return self._marked("*", node, depth, cell)

    on_strong, on_em = on_b, on_i

    def on_pre(self, node: Node, depth: int, cell: bool) -> str:
        body = strip_end(node.content())
        fence = _fence(body, 3)
        return body if cell else f"\n{fence}\n{body}\n{fence}\n"

    def on_code(self, node: Node, depth: int, cell: bool) -> str:
        body = strip(self.inner(node, depth, cell))
        return body and _fence(body, 1) + body + _fence(body, 1)

    def on_a(self, node: Node, depth: int, cell: bool) -> str:
        target = urls.unwrapped(node.get("href"))
        raw = self.inner(node, depth, cell)
        text = re.sub(r"([\\\[\]])", r"\\\1", squeeze(strip(raw)))
        blank = " " if raw and not text else ""
        if not urls.safe_link(target):
            return text or blank
        shown = "".join(_ESCAPES.get(c) or ("".join(f"%{b:02X}" for b in c.encode()) if RUN.fullmatch(c) else c) for c in target)
        if not text:
            return blank or shown
        return shown if text == target else f"[{text}]({shown})"

    def on_img(self, node: Node, depth: int, cell: bool) -> str:
        source, alt = strip(node.get("src")), strip(node.get("alt"))
        sides = [int(m.group()) for side in ("width", "height") if (m := re.match(r"[+-]?[0-9]+", strip(node.get(side))))]
        if any(n and n <= 2 for n in sides) or TRACKERS.search(source) or urls.interface_image(source):
            return ""
        if re.match("data:|cid:", source, re.I):
            return f"[inline image: {alt}]" if alt else "[inline image]"
        return f"[image: {alt}]" if alt else "[image]" if urls.safe_link(source) else ""

    def on_table(self, node: Node, depth: int, cell: bool) -> str:
        grid = [row.elements("td", "th") for row in table_rows(node)]
        width = max(map(len, grid), default=0)
        if cell or width <= 1 or node.find(lambda n: n.tag == "table"):
            return self.inner(node, depth, cell)  # layout, not data
        flat = lambda c: strip(re.sub(rf"[{SPACES}]*\n+[{SPACES}]*", " ", self.write(c, depth, True)).replace("|", "\\|"))
        rows = [[flat(c) for c in row] + [""] * (width - len(row)) for row in grid]
        if all(c in ("", "[image]") for row in rows for c in row):
            return ""
        rows.insert(1, ["---"] * width)
        return "\n" + "\n".join(f"| {' | '.join(row)} |" for row in rows) + "\n"

    def _list(self, node: Node, depth: int, cell: bool) -> str:
        items = node.elements("li")
        if not items:
            return self.inner(node, depth, cell)
        margin, lines = "  " * depth, []
        for k, item in enumerate(items, 1):
            body = strip(re.sub("\n{2,}", "\n", self.inner(item, depth + 1, cell)))
            lines.append(margin + (f"{k}. " if node.tag == "ol" else "- ") + body.replace("\n", f"\n{margin}  "))
        return "\n" + "\n".join(lines) + "\n"

    on_ul = on_ol = _list

    def on_li(self, node: Node, depth: int, cell: bool) -> str:
        return "\n- " + strip(self.inner(node, depth, cell))

    def on_blockquote(self, node: Node, depth: int, cell: bool) -> str:
        own = node.elements()
        prose = any(c.tag is None and strip(c.text) for c in node.children)
        if own and not prose and all(c.tag in ("ul", "ol") for c in own):
            return self.inner(node, depth, cell)  # an indented list, not a quotation
        body = strip(self.inner(node, depth, cell))
        return body and "\n" + "\n".join(f"> {line}" for line in body.split("\n")) + "\n"


_WRITER = _Writer()


def markdown(node: Node | None) -> str:
    """A tree as Markdown: blank lines and inner blanks squeezed, indentation kept."""
    if node is None:
        return ""
    out = re.sub(r"[ \t]+\n", "\n", _WRITER.write(node, 0, False))
    out = re.sub(r"\n{3,}", "\n\n", out)
    return strip(re.sub(r"([^\n \t])[ \t]{2,}", r"\1 ", out))


def html_to_markdown(html: str | None) -> str:
    return markdown(parse(html))
