"""A small HTML tree with the implied tags that browsers add.

Built over the standard library's tokenizer: void elements, ends implied by
starts (p, li, dd, dt, option, table parts), implied tbody and tr, and formatting
elements that are open when a block ends are opened again in the next one (three
identical ones at most). A formatting element that ends inside a block it was
opened outside of is split around that block. Deviations from HTML5: text straight
inside a table stays there, and elements nested more than ``DEEPEST`` deep become
siblings of the deepest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
SCOPES = {"applet", "caption", "html", "marquee", "object", "table", "td", "template", "th"}
#: For a start tag: the open elements that it ends, and those that keep it from looking further out.
ENDED_BY = {
    "li": ({"li"}, SCOPES | {"ol", "ul"}),
    "dd": ({"dd", "dt"}, SCOPES | {"dl"}),
    "dt": ({"dd", "dt"}, SCOPES | {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"})),
}
DEEPEST = 400


class Node:
    """An element, or text if it has no tag."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def is_a(self, tag: str = "", cls: str = "") -> bool:
        return self.tag is not None and (not tag or self.tag == tag) and (not cls or cls in self.get("class").split())

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order; what is removed meanwhile is not entered."""
        todo = self.children[::-1]
        while todo:
            node = todo.pop()
            if node.parent is None:
                continue
            yield node
            if node.parent is not None:
                todo += node.children[::-1]

    def find_all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if n.tag is not None and test(n)]

    def find(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if n.tag is not None and test(n)), None)

    def closest(self, test: Callable[[Node], bool]) -> Node | None:
        node: Node | None = self
        while node is not None and not (node.tag is not None and test(node)):
            node = node.parent
        return node

    def inside(self, root: Node) -> bool:
        return self.closest(lambda n: n is root) is not None

    def elements(self, *tags: str) -> list[Node]:
        return [c for c in self.children if c.tag is not None and (not tags or c.tag in tags)]

    def content(self) -> str:
        return self.text if self.tag is None else "".join(n.text for n in self.walk() if n.tag is None)

    def copy(self) -> Node:
        out = Node(self.tag, dict(self.attrs), self.text)
        todo = [(self, out)]
        while todo:
            old, new = todo.pop()
            for c in old.children:
                todo.append((c, new.add(Node(c.tag, dict(c.attrs), c.text))))
        return out


def table_rows(table: Node) -> list[Node]:
    """Rows straight in a table, its bodies and its heads, in document order."""
    return [r for c in table.elements("tbody", "thead", "tr") for r in ([c] if c.tag == "tr" else c.elements("tr"))]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        self.active: list[Node | None] = []  # formatting elements to open again; None marks a table cell

    @property
    def here(self) -> Node:
        return self.open[-1]

    def _depth(self, tags: set[str], stop: set[str]) -> int | None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in stop:
                return None
        return None

    def _cut(self, depth: int) -> None:
        """Close everything from ``depth`` on; formatting elements stay active, but not out of a cell."""
        cells = sum(n.tag in ("td", "th", "caption") for n in self.open[depth:])
        for _ in range(cells):
            if None in self.active:
                del self.active[len(self.active) - 1 - self.active[::-1].index(None) :]
        del self.open[depth:]

    def _push(self, node: Node) -> Node:
        self.here.add(node)
        if len(self.open) < DEEPEST:
            self.open.append(node)
        return node

    def _reopen(self) -> None:
        since = len(self.active) - self.active[::-1].index(None) if None in self.active else 0
        for k in range(since, len(self.active)):
            if self.active[k] not in self.open:
                old = self.active[k]
                self.active[k] = self._push(Node(old.tag, dict(old.attrs)))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag in ENDED_BY and (at := self._depth(*ENDED_BY[tag])) is not None:
            self._cut(at)
        if tag in ENDS_P and (at := self._depth({"p"}, SCOPES | {"button"})) is not None:
            self._cut(at)
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            self._in_table(tag)
        elif tag in FORMATTING:
            self._formatting(node)
            return
        elif tag not in ENDS_P and tag not in ENDED_BY:
            self._reopen()
        if tag in VOID:
            self.here.add(node)
            return
        self._push(node)
        if tag in ("td", "th", "caption"):
            self.active.append(None)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def _in_table(self, tag: str) -> None:
        """Close what is open inside the table part, and add the parts that are implied."""
        parts = {"table", "tbody", "thead", "tfoot"} | ({"tr"} if tag in ("td", "th") else set())
        at = self._depth({"table"} if tag not in ("td", "th", "tr") else parts, set())
        if at is None:
            return
        self._cut(at + 1)
        if tag in ("td", "th", "tr") and self.here.tag == "table":
            self._push(Node("tbody"))
        if tag in ("td", "th") and self.here.tag != "tr":
            self._push(Node("tr"))

    def _formatting(self, node: Node) -> None:
        since = len(self.active) - self.active[::-1].index(None) if None in self.active else 0
        if node.tag == "a" and any(n.tag == "a" for n in self.active[since:]):
            self.handle_endtag("a")
            since = min(since, len(self.active))
        self._reopen()
        same = [n for n in self.active[since:] if n.tag == node.tag and n.attrs == node.attrs]
        if len(same) >= 3:
            self.active.remove(same[0])
        self.active.append(self._push(node))

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and self._depth({"p"}, SCOPES | {"button"}) is None:
            self.here.add(Node("p"))
        elif tag in FORMATTING:
            self._end_formatting(tag)
        elif tag not in VOID:
            stop = {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else set() if tag in SCOPES or tag in ("body", "html") else {"td", "th", "caption", "table"}
            if (at := self._depth({tag}, stop - {tag})) is not None:
                self._cut(at)

    def _end_formatting(self, tag: str) -> None:
        at = self._depth({tag}, SCOPES)
        node = self.open[at] if at is not None else next((n for n in reversed(self.active) if n is None or n.tag == tag), None)
        if node is None:
            return
        if node in self.active:
            self.active.remove(node)
        if at is None:
            return
        block = next((k for k in range(at + 1, len(self.open)) if self.open[k].tag not in FORMATTING and self.open[k].tag != "span"), None)
        if block is None:
            del self.open[at:]
            return
        # The block moves out of the element, whose copy goes around what the block holds so far.
        inner = self.open[block]
        inner.remove()
        node.parent.add(inner)
        around = Node(node.tag, dict(node.attrs))
        kept, inner.children = inner.children, []
        inner.add(around)
        for c in kept:
            around.add(c)
        moved = [n for n in self.open[at + 1 : block] if n in self.active]
        self.open[at:block] = []
        for n in moved:
            self.active[self.active.index(n)] = Node(n.tag, dict(n.attrs))
        del self.open[self.open.index(inner) + 1 :]

    def handle_data(self, data: str) -> None:
        if data.strip() or self.here.tag not in ("table", "tbody", "thead", "tfoot", "tr"):
            if self.here.tag not in ("title", "script", "style"):
                self._reopen()
            self.here.add(Node(None, text=data))


def parse(html: str | None) -> Node:
    """The tree of a whole text; never fails."""
    builder = _Builder()
    builder.feed((html or "").replace("\r\n", "\n").replace("\x00", "�"))
    builder.close()
    return builder.root
