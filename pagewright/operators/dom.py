"""A small document tree built from loose HTML, row-local within one Arrow batch.

The builder follows the tree rules that the pages need: implied html, head and body; paragraphs closed by block starts; items, cells
and options closed by their like; formatting that a block begins in parted around it; raw text in scripts and styles; void elements; stray end tags ignored; an end tag closes
what is open within it, but not beyond a cell or button; what may not stand in a table goes before it. Elements nested more than MOST_DEPTH deep become
siblings at that depth, as in browsers, so that no page is too deep to work on and no content is lost.
"""

from __future__ import annotations

import html as _html
import re
import sys
from collections.abc import Callable, Iterator

#: Levels of nested elements.
MOST_DEPTH = 512
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * MOST_DEPTH))

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPED_RAW = frozenset(("title", "textarea"))
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu "
    "nav ol p pre section summary table ul".split()
)
BLOCKS = CLOSES_P | frozenset(("li", "dd", "dt"))
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
#: For a start tag, the open elements that it closes and those that stop the search.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
}
#: Parts of a table that hold only other parts, and what may stand in them.
IN_TABLE = frozenset("table tbody thead tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col tbody tfoot thead tr td th style script template form #comment".split())
SCOPE_STOPS = frozenset("table td th caption html button object template marquee".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())

_TOKEN = re.compile(r"<!--(.*?)(?:-->|$)|<!([a-zA-Z][^>]*)>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<\?[^>]*>", re.S)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"[\t\n\f\r ]+")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    # structure ------------------------------------------------------------------------------------------------
    def append(self, child: Node | str) -> None:
        if isinstance(child, str):
            if self.children and isinstance(self.children[-1], str):
                self.children[-1] += child
            else:
                self.children.append(child)
        else:
            if child.parent:
                child.remove()
            child.parent = self
            self.children.append(child)

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def remove(self) -> None:
        if self.parent:
            del self.parent.children[self.index()]
            self.parent = None

    def replace_with(self, *new: Node | str) -> None:
        parent, i = self.parent, self.index()
        self.parent = None
        for n in new:
            if isinstance(n, Node):
                if n.parent:
                    n.remove()
                n.parent = parent
        parent.children[i : i + 1] = new

    def unwrap(self) -> None:
        own = self.children
        self.children = []
        for c in own:
            if isinstance(c, Node):
                c.parent = None
        self.replace_with(*own)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order; changes within an element already given are seen."""
        for c in list(self.children):
            if isinstance(c, Node):
                yield c
                if c.parent is not None:
                    yield from c.walk()

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def has_ancestor(self, tag: str, depth: int = 0, test: Callable[[Node], bool] | None = None) -> bool:
        """Whether an ancestor has the tag; depth 3 looks at four levels, 0 at all."""
        for level, n in enumerate(self.ancestors()):
            if depth and level > depth:
                return False
            if n.tag == tag and (test is None or test(n)):
                return True
        return False

    def clone(self) -> Node:
        n = Node(self.tag, dict(self.attrs))
        for c in self.children:
            n.append(c if isinstance(c, str) else c.clone())
        return n

    # text -----------------------------------------------------------------------------------------------------
    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag != "#comment":
                yield from c.strings()

    def raw_text(self) -> str:
        return "".join(self.strings())

    def text(self) -> str:
        """Text with blocks set apart by blanks, white space collapsed."""
        parts: list[str] = []

        def add(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    parts.append(c)
                elif c.tag in ("#comment", "script", "style"):
                    continue
                elif c.tag in INLINE:
                    add(c)
                else:
                    parts.append(" ")
                    add(c)
                    parts.append(" ")

        add(self)
        return _SPACE.sub(" ", "".join(parts)).strip()

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    @property
    def key(self) -> str:
        return f"{self.get('class')} {self.get('id')}"

    # output ---------------------------------------------------------------------------------------------------
    def inner_html(self) -> str:
        out: list[str] = []
        for c in self.children:
            _write(c, out, self.tag)
        return "".join(out)

    def outer_html(self) -> str:
        out: list[str] = []
        _write(self, out, "")
        return "".join(out)


INLINE = frozenset(
    "a abbr acronym b bdo big button cite code data del dfn em font i img input ins kbd label mark math output q ruby s samp select small span strike strong "
    "sub sup textarea time tt u var wbr".split()
)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _write(n: Node | str, out: list[str], parent: str) -> None:
    if isinstance(n, str):
        out.append(n if parent in RAW else escape(n))
    elif n.tag == "#comment":
        out.append(f"<!--{n.get('text')}-->")
    else:
        attrs = "".join(f' {k}="{escape(v).replace(chr(34), "&#34;")}"' for k, v in n.attrs.items())
        out.append(f"<{n.tag}{attrs}>" if n.tag not in VOID else f"<{n.tag}{attrs}/>")
        if n.tag not in VOID:
            for c in n.children:
                _write(c, out, n.tag)
            out.append(f"</{n.tag}>")


class _Builder:
    def __init__(self) -> None:
        self.root = Node("html")
        self.head: Node | None = None
        self.body: Node | None = None
        self.open: list[Node] = [self.root]
        self.lost: list[Node] = []

    def _put(self, n: Node | str) -> None:
        """Appends to the innermost open element, or before the open table where it may not stand in it."""
        last = self.open[-1]
        stray = bool(n.strip()) if isinstance(n, str) else n.tag not in TABLE_PARTS and not (n.tag == "input" and n.get("type") == "hidden")
        if last.tag in IN_TABLE and stray:
            table = next((x for x in reversed(self.open) if x.tag == "table"), None)
            if table is not None and table.parent is not None:
                parent, i = table.parent, table.index()
                if isinstance(n, str):
                    if i and isinstance(parent.children[i - 1], str):
                        parent.children[i - 1] += n
                        return
                else:
                    n.parent = parent
                parent.children.insert(i, n)
                return
        last.append(n)

    def _ensure_body(self) -> None:
        if self.body is None:
            if self.head is None:
                self.head = Node("head")
                self.root.append(self.head)
            self.body = Node("body")
            self.root.append(self.body)
            self.open = [self.root, self.body]

    def _close_until(self, tags: tuple[str, ...], stops: tuple[str, ...] | frozenset[str]) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i].tag
            if t in tags:
                del self.open[i:]
                return True
            if t in stops:
                return False
        return False

    def _close_p(self) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i].tag
            if t == "p":
                self.lost = [Node(n.tag, dict(n.attrs)) for n in self.open[i + 1 :] if n.tag in FORMATTING]
                del self.open[i:]
                return
            if t in SCOPE_STOPS:
                return

    def text(self, data: str) -> None:
        if self.body is None:
            if not data.strip():
                return
            self._ensure_body()
        if self.lost and data.strip():
            self._reopen()
        self._put(data)

    def _reopen(self) -> None:
        again, self.lost = self.lost, []
        for n in again:
            self.open[-1].append(n)
            self.open.append(n)

    def start(self, tag: str, attrs: dict[str, str]) -> Node | None:
        if tag == "html":
            self.root.attrs = {**attrs, **self.root.attrs}
            return None
        if tag == "head":
            if self.head is None:
                self.head = Node("head", attrs)
                self.root.append(self.head)
            return None
        if tag == "body":
            self._ensure_body()
            self.body.attrs = {**attrs, **self.body.attrs}
            return None
        n = Node(tag, attrs)
        if self.body is None and tag in HEAD_TAGS:
            if self.head is None:
                self.start("head", {})
            self.head.append(n)
            return n
        self._ensure_body()
        if tag in CLOSES_P:
            self._close_p()
            if tag[0] == "h" and tag[1:].isdigit() and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:].isdigit():
                self.open.pop()
        if tag in CLOSED_BY:
            tags, stops = CLOSED_BY[tag]
            while self._close_until(tags, stops) and tag in ("tr", "tbody", "thead", "tfoot"):
                pass
            if tag in ("li", "dd", "dt"):
                self._close_p()
        if tag == "tr" and self.open[-1].tag == "table":
            self.start("tbody", {})
        elif tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {})
        elif tag == "col" and self.open[-1].tag == "table":
            self.start("colgroup", {})
        if tag == "a":
            self._close_until(("a",), SCOPE_STOPS)
        if tag not in CLOSES_P and self.lost and tag not in VOID:
            self._reopen()
        if len(self.open) > MOST_DEPTH:
            self.open.pop()
        self._put(n)
        if tag not in VOID:
            self.open.append(n)
        return n

    def _part(self, i: int) -> None:
        """Ends a formatting element that a block has begun in: the block goes behind it and holds a copy of it around what the block holds so far."""
        outer, block = self.open[i], self.open[i + 1]
        block.remove()
        outer.parent.children.insert(outer.index() + 1, block)
        block.parent = outer.parent
        inner = Node(outer.tag, dict(outer.attrs))
        for c in list(block.children):
            if isinstance(c, Node):
                c.parent = None
            inner.append(c)
        block.children = []
        block.append(inner)
        del self.open[i]

    def end(self, tag: str) -> None:
        if tag in ("html", "head", "body"):
            if tag == "head" and self.head is not None:
                self._ensure_body()
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self._ensure_body()
            self.open[-1].append(Node("p"))
            return
        if tag == "br":
            self.start("br", {})
            return
        if tag in FORMATTING and any(n.tag == tag for n in self.lost):
            self.lost = [n for n in self.lost if n.tag != tag]
            return
        for i in range(len(self.open) - 1, 1, -1):
            t = self.open[i].tag
            if t == tag:
                if tag in FORMATTING and len(self.open) > i + 1 and self.open[i + 1].tag in BLOCKS:
                    self._part(i)
                    return
                if tag in FORMATTING or tag == "p":
                    self.lost = [Node(n.tag, dict(n.attrs)) for n in self.open[i + 1 :] if n.tag in FORMATTING] if tag == "p" else []
                del self.open[i:]
                return
            if t in ("td", "th", "table", "button", "caption") and tag not in ("tr", "tbody", "thead", "tfoot", "table"):
                return


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), _html.unescape(value) if "&" in value else value)
    return out


def parse(source: str, comments: bool = False) -> Node:
    """The tree of a page: its html element with a head and a body."""
    b, at, n = _Builder(), 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            b.text(_html.unescape(source[at:]))
            break
        if m.start() > at:
            data = source[at : m.start()]
            b.text(_html.unescape(data) if "&" in data else data)
        at = m.end()
        if m[1] is not None and comments:
            b._ensure_body()
            b.open[-1].append(Node("#comment", {"text": m[1]}))
        if m[4] is None:
            continue
        tag = m[4].lower()
        if m[3]:
            b.end(tag)
            continue
        node = b.start(tag, _attributes(m[5]) if m[5] else {})
        if tag in RAW or tag in ESCAPED_RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            stop = end.start() if end else n
            data = source[at:stop]
            if node is not None:
                node.append(_html.unescape(data) if tag in ESCAPED_RAW else data)
                if b.open[-1] is node:
                    b.open.pop()
            at = end.end() if end else n
    b._ensure_body()
    return b.root


def body_of(root: Node) -> Node:
    return next(c for c in root.elements() if c.tag == "body")


def head_of(root: Node) -> Node:
    return next(c for c in root.elements() if c.tag == "head")
