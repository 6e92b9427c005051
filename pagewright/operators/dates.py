"""Dates and bylines of pages by weighted selectors: metadata first, then what is visible."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pagewright.operators.dom import Node, parse

#: Metadata with dates, as (element, attribute that names it, name, attribute with the value, score).
DATE_METAS = (
    ("meta", "property", "article:published_time", 13), ("meta", "property", "og:updated_time", 10), ("meta", "property", "og:article:published_time", 10),
    ("meta", "property", "og:article:modified_time", 10), ("meta", "name", "pubdate", 10), ("meta", "name", "publishdate", 10), ("meta", "name", "date", 9),
    ("meta", "property", "article:published", 7), ("meta", "itemprop", "datePublished", 3), ("time", "", "", 3), ("meta", "itemprop", "dateModified", 2),
    ("meta", "property", "article:modified_time", 2), ("meta", "name", "DC.date.issued", 2), ("meta", "name", "DC.date.created", 2),
    ("meta", "name", "DC.date.modified", 1), ("meta", "name", "dcterms.modified", 1), ("meta", "name", "dcterms.created", 1),
)
#: Visible elements with dates, as (element or *, word of its class, whether the class is just this word, score).
DATE_ELEMENTS = (
    ("span", "date", True, 3), ("span", "time", True, 3), ("span", "timestamp", True, 3), ("span", "published", True, 3), ("time", "", False, 2),
    ("span", "date", False, 2), ("div", "date", False, 2), ("p", "date", False, 2), ("p", "time", False, 2), ("div", "byline", False, 1),
    ("p", "byline", False, 1), ("*", "dateline", False, 1),
)
#: Metadata with authors and their scores, then elements.
BYLINE_METAS = (
    ("property", "article:author", 10), ("property", "og:article:author", 9), ("name", "author", 8), ("name", "sailthru.author", 7), ("name", "byl", 6),
    ("name", "twitter:creator", 5), ("property", "book:author", 4), ("name", "dc.creator", 3), ("name", "dcterms.creator", 3),
)
BYLINE_ELEMENTS = (("a", "rel", "author", 2), ("span", "class", "author", 1), ("p", "class", "author", 1), ("div", "class", "author", 1), ("span", "class", "byline", 1), ("p", "class", "byline", 1), ("div", "class", "byline", 1), ("span", "itemprop", "author", 1), ("div", "itemprop", "author", 1))
BYLINE_PREFIXES = ("By ", "by ", "Author: ", "Written by ", "Posted by ", "Published by ", "Reported by ")
BYLINE_SUFFIXES = (" | Author", " | Writer", " | Reporter", " | Staff")


def clean_byline(text: str) -> str:
    text = text.strip()
    for p in BYLINE_PREFIXES:
        if text.startswith(p):
            text = text[len(p) :].strip()
    for s in BYLINE_SUFFIXES:
        if text.endswith(s):
            text = text[: -len(s)].strip()
    return text


def page_byline(html: str) -> str:
    """The author by metadata, then elements, each by score and document order, then paragraphs that begin with By; empty if none."""
    root = parse(html)
    nodes = list(root.walk())
    for attribute, name, _ in sorted(BYLINE_METAS, key=lambda x: -x[2]):
        for n in nodes:
            if n.tag == "meta" and n.get(attribute) == name and (v := clean_byline(n.get("content"))):
                return v
    found = [(-score, i, v) for tag, attribute, word, score in BYLINE_ELEMENTS for i, n in enumerate(nodes) if n.tag == tag and word in n.get(attribute) and (v := clean_byline(n.text()))]
    if found:
        return min(found)[2]
    own = [clean_byline(t) for n in nodes if n.tag == "p" and (t := n.raw_text()).lower().startswith(("by ", "written by "))]
    return own[-1] if own else ""


def date_candidates(root: Node) -> list[tuple[str, int, bool]]:
    """(text, score, whether from metadata), the best first; equal texts add their scores."""
    scores: dict[tuple[str, bool], int] = {}
    order: dict[tuple[str, bool], int] = {}

    def add(text: str, score: int, meta: bool) -> None:
        if text := text.strip():
            scores[text, meta] = scores.get((text, meta), 0) + score
            order.setdefault((text, meta), len(order))

    nodes = list(root.walk())
    for tag, attribute, name, score in DATE_METAS:
        for n in nodes:
            if n.tag == tag and (not attribute or n.get(attribute) == name):
                add(n.get("content" if tag == "meta" else "datetime"), score, True)
    for tag, word, exact, score in DATE_ELEMENTS:
        for n in nodes:
            if tag in ("*", n.tag) and (n.get("class") == word if exact else word in n.get("class")):
                add(n.text(), score, False)
    return [(t, scores[t, m], m) for t, m in sorted(scores, key=lambda k: (-scores[k], order[k]))]


def page_date(html: str, as_of: dt.datetime | None = None, parser: Callable[[str], dt.datetime | None] | None = None) -> dt.datetime | None:
    """The first candidate with a time of day, else the first with a date, else a relative one if as_of is given."""
    read = parser or read_date
    dates = [d for t, _, _ in date_candidates(parse(html)) if (d := read(t))]
    timed = [d for d in dates if (d.hour, d.minute, d.second) != (0, 0, 0)]
    if timed or dates:
        return (timed or dates)[0]
    if as_of is not None:
        for t, _, _ in date_candidates(parse(html)):
            if (s := relative_seconds(t)) is not None:
                return (as_of - dt.timedelta(seconds=s)).replace(microsecond=0)
    return None


def relative_seconds(text: str) -> int | None:
    from pagewright.functions.dates import NAMED, UNITS

    t = text.lower()
    for p, s in UNITS:
        if m := re.search(rf"(\d+)\s*{p}\s*ago", t):
            return int(m[1]) * s
    return next((s for p, s in NAMED if re.search(p, t)), None)


def read_date(text: str) -> dt.datetime | None:
    """One written date, without zone as UTC; the same grammar as the timestamp operator, month before day."""
    import pandas as pd

    from pagewright.functions.dates import AROUND
    from pagewright.operators.timestamps import to_utc_seconds

    for phrase in ("", *AROUND):
        own = text
        if phrase:
            at = text.lower().find(phrase)
            if at < 0:
                continue
            own = text = text[:at] + text[at + len(phrase) :]
        for order in ("mdy", "dmy"):
            s = to_utc_seconds(pd.Series([own.strip()]), pd.Series(["UTC"]), pd.Series([order]))[0]
            if s is not pd.NA:
                return dt.datetime.fromtimestamp(int(s), dt.timezone.utc)
    return None
