"""Single fields of a page's metadata, bylines beside an element, shares of text, and names of content types."""

from __future__ import annotations

from pagewright.functions import rules
from pagewright.operators import measures as M
from pagewright.operators.dom import Node

#: Names of metadata for each field, in order.
FIELDS = {
    "author": "author byline dc.creator article:author creator og:article:author".split(),
    "date": "date created article:published_time article:modified_time publication_date sailthru.date timestamp dc.date og:published_time og:updated_time publication-date modified-date last-modified".split(),
    "sitename": "og:site_name application-name site_name publisher dc.publisher copyright".split(),
    "description": "description og:description dc.description twitter:description".split(),
    "title": "title og:title dc.title twitter:title".split(),
}


def meta_field(root: Node, field: str, default: str = "") -> str:
    """A field of a page's metadata by its names in order, each as name, property or itemprop."""
    metas = root.find_all("meta")
    for name in FIELDS.get(field, [field]):
        for attribute in ("name", "property", "itemprop"):
            for m in metas:
                value = m.get("content") or (m.get("value") if name.startswith("twitter:") else "")
                if m.get(attribute) == name and value:
                    return value.strip()
    title = root.find("title") if field == "title" else None
    return title.raw_text().strip() or default if title is not None else default


def root_title(root: Node) -> str:
    """The title element, else the metadata's, else the last part of the base address in words."""
    title = root.find("title")
    text = (title.raw_text().strip() if title is not None else "") or meta_field(root, "title")
    if text:
        return text
    base = next((b.get("href") for b in root.find_all("base")), "")
    last = base.rsplit("/", 1)[-1]
    stem = last[: last.rindex(".")] if "." in last[1:] else last
    return stem.replace("-", " ").replace("_", " ").title()


def adjacent_byline(n: Node) -> str:
    """A valid byline in the element before or after, if its class tells one."""
    own = n.parent.elements() if n.parent is not None else []
    i = next((k for k, c in enumerate(own) if c is n), 0)
    for j in (i - 1, i + 1):
        if 0 <= j < len(own) and M.BYLINE.search(own[j].get("class")) and M.is_valid_byline(own[j].text()):
            return own[j].text()
    return ""


def text_density(n: Node, *tags: str) -> float:
    """The share of a node's text that stands in elements of some tags."""
    size = M.nbytes(n.text())
    return sum(M.nbytes(x.text()) for x in n.find_all(*tags)) / size if size and tags else 0.0


def type_name(code: int) -> str:
    return rules.CONTENT_TYPES[code] if 0 <= code < len(rules.CONTENT_TYPES) else "Unknown"
