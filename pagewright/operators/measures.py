"""Measures of tree nodes: the same rules as the column expressions, for use while a tree changes."""

from __future__ import annotations

import re

from pagewright.functions import rules
from pagewright.operators.dom import Node

UNLIKELY, MAYBE = re.compile(rules.UNLIKELY), re.compile(rules.MAYBE)
POSITIVE, NEGATIVE = re.compile(rules.POSITIVE), re.compile(rules.NEGATIVE)
BYLINE, SHARE, VIDEOS = re.compile(rules.BYLINE), re.compile(rules.SHARE, re.ASCII), re.compile(rules.VIDEOS)
_TOKENS = re.compile(r"[^0-9A-Za-z_]+")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def nbytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def visible(n: Node) -> bool:
    if "display:none" in n.get("style") or "hidden" in n.attrs:
        return False
    return n.get("aria-hidden") != "true" or "fallback-image" in n.get("class")


def class_weight(n: Node) -> int:
    out = 0
    for v in (n.get("class"), n.get("id")):
        if v:
            out += rules.CLASS_WEIGHT * (bool(POSITIVE.search(v)) - bool(NEGATIVE.search(v)))
    return out


def link_density(n: Node, text: str | None = None) -> float:
    size = nbytes(n.text() if text is None else text)
    if not size:
        return 0.0
    total = 0
    for a in n.find_all("a"):
        if a.get("data-type") in ("indexterm", "noteref"):
            continue
        share = rules.HASH_LINK_SHARE if re.match(r"#.+", a.get("href")) else 1.0
        total += int(nbytes(a.text()) * share)
    return total / size


def is_unlikely(n: Node) -> bool:
    return bool(UNLIKELY.search(n.key)) and not MAYBE.search(n.key)


def has_block_child(n: Node) -> bool:
    return any(c.tag in rules.BLOCK_IN_DIV for c in n.walk())


def is_phrasing(n: Node | str) -> bool:
    if isinstance(n, str) or n.tag in rules.PHRASING:
        return True
    return n.tag in ("a", "del", "ins") and all(is_phrasing(c) for c in n.children)


def without_content(n: Node) -> bool:
    own = n.elements()
    return not n.raw_text().strip() and all(c.tag in ("br", "hr") for c in own)


def single_child(n: Node, tag: str) -> Node | None:
    """The only element child if it has the tag and no text stands beside it."""
    own = n.elements()
    if len(own) == 1 and own[0].tag == tag and not any(isinstance(c, str) and c.strip() for c in n.children):
        return own[0]
    return None


def single_image(n: Node) -> bool:
    if n.tag == "img":
        return True
    own = n.elements()
    return len(own) == 1 and not n.raw_text().strip() and single_image(own[0])


def is_allowed_video(n: Node) -> bool:
    return any(VIDEOS.search(v) for v in n.attrs.values()) or (n.tag == "object" and bool(VIDEOS.search(n.inner_html())))


def similarity(a: str, b: str) -> float:
    x, y = a.lower(), b.lower()
    if x == y:
        return 1.0
    ta, tb = [t for t in _TOKENS.split(x) if t], [t for t in _TOKENS.split(y) if t]
    if not ta or not tb:
        return 0.0
    own = set(tb)
    shared = sum(t in own for t in ta)
    return shared / (len(ta) + len(tb) - shared)


def is_important_link(text: str) -> bool:
    t = text.lower()
    return any(p in t for p in rules.IMPORTANT_LINKS) or ("..." in t and nbytes(t) < 30) or t == "more" or t.endswith(" more")


def is_valid_byline(text: str) -> bool:
    t = text.strip()
    size = nbytes(t)
    if not 1 <= size <= 100:
        return False
    return not re.search("[/•·|—-]", t) or sum(map(str.isdigit, t)) <= 0.3 * size


def list_has_content(n: Node) -> bool:
    """Whether the items of a list hold more than links, or much text."""
    size = links = 0
    for li in n.find_all("li"):
        size += nbytes(li.text())
        links += sum(nbytes(a.text()) for a in li.find_all("a") if a.get("data-type") not in ("indexterm", "noteref"))
    return bool(size) and (links / size < rules.LIST_LINK_DENSITY or size > rules.MIN_LIST_TEXT)


def table_cells(t: Node) -> list[list[Node]]:
    return [r.find_all("td", "th") for r in t.find_all("tr")]


def table_shape(t: Node) -> tuple[int, int, int]:
    """Rows, most columns of a row with their spans, and cells of a table."""
    rows = table_cells(t)
    span = lambda c: int(c.get("colspan") or 1) if (c.get("colspan") or "1").isdigit() else 0
    return len(rows), max((sum(map(span, r)) for r in rows), default=0), len(t.find_all("td", "th"))


def table_link_density(t: Node) -> float:
    size = nbytes(t.text())
    return sum(nbytes(a.text()) for a in t.find_all("a")) / size if size else 0.0


def _listed(n: Node, listed: tuple[str, ...]) -> bool:
    key = n.key.lower()
    return any(w in key for w in listed)


def is_layout_table(t: Node) -> bool:
    if t.get("role") == "presentation" or t.get("datatable") == "0":
        return True
    if t.get("width") == "100%" and t.get("border", "0") == "0" and t.get("cellspacing", "0") == "0":
        return True
    return _listed(t, rules.LAYOUT_TABLE_WORDS)


def is_data_table(t: Node) -> bool:
    if t.get("summary") or any(c.raw_text() for c in t.find_all("caption")) or t.find(*rules.DATA_TABLE_TAGS):
        return True
    counts = [len(r) for r in table_cells(t)]
    return _listed(t, rules.DATA_TABLE_WORDS) or (len(counts) >= 2 and counts[0] > 1 and len(set(counts)) == 1)


def is_nav_table(t: Node) -> bool:
    items = len(t.find_all("li"))
    return (
        table_link_density(t) > rules.NAV_TABLE_DENSITY
        or _listed(t, rules.NAV_TABLE_WORDS)
        or (items > 3 and len(t.find_all("a")) >= int(items * 0.8))
    )


def table_class(t: Node) -> str:
    """layout, data or nav: the first rule that tells."""
    if is_layout_table(t):
        return "layout"
    if is_data_table(t):
        return "data"
    if is_nav_table(t):
        return "nav"
    if sum(n.tag == "table" for n in t.ancestors()) > rules.TABLE_NESTING:
        return "layout"
    rows, columns, cells = table_shape(t)
    if rows >= rules.DATA_TABLE_ROWS or columns > rules.DATA_TABLE_COLUMNS or cells > rules.DATA_TABLE_CELLS:
        return "data"
    text = t.text()
    return "data" if nbytes(text) > rules.LAYOUT_TABLE_TEXT and link_density(t, text) < 0.3 else "layout"
