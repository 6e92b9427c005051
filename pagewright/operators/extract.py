"""Extraction of the article from a page: one Arrow stage for each batch of pages, one parse for each page.

Stages of a page: metadata, removal of scripts, preparation, pruning, scoring, choice of the top candidate with its siblings, cleaning, and
output as markup, plain markup and text blocks. A page that gives too little text is tried again with weaker rules, each
time from an untouched copy. Pages are rows, so the operator is narrow: it needs no shuffle and runs on streams as it does on tables.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import time
import unicodedata
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pagewright.functions import rules
from pagewright.operators import measures as M
from pagewright.operators.dom import Node, body_of, escape, head_of, parse
from pagewright.options import ExtractOptions
from pagewright.schema import ARTICLE

STRIP_UNLIKELY, WEIGH_CLASSES, CLEAN_CONDITIONALLY = 1, 2, 4
ALL_RULES = STRIP_UNLIKELY | WEIGH_CLASSES | CLEAN_CONDITIONALLY
_META_PROPERTY = re.compile(r"\s*(dc|dcterm|og|twitter)\s*:\s*(author|creator|description|title|site_name)\s*")
_META_NAME = re.compile(r"^\s*(?:(dc|dcterm|og|twitter|weibo:(?:article|webpage))\s*[.:]\s*)?(author|creator|description|title|site_name)\s*$", re.I)
_IMAGE = re.compile(r"\.(jpg|jpeg|png|webp)", re.I)


class Timeout(Exception):
    pass


# Metadata -----------------------------------------------------------------------------------------------------------
def json_ld(root: Node) -> dict[str, str]:
    """Fields of the first script with linked data of an article; read by patterns, as pages often hold invalid JSON."""
    for script in root.find_all("script"):
        if script.get("type") != "application/ld+json":
            continue
        text = script.raw_text()
        if not re.search(r'"@context"\s*:\s*"https?://schema\.org/?"', text):
            continue
        kind = re.search(r'"@type"\s*:\s*"([^"]+)"', text)
        if not kind or not re.search(rules.ARTICLE_TYPES, kind[1]):
            continue
        out = {}
        for field, pattern in (
            ("title", r'"(?:name|headline)"\s*:\s*"([^"]+)"'),
            ("byline", r'"author"\s*:\s*\{\s*(?:"@type"\s*:\s*"[^"]*"\s*,\s*)?"name"\s*:\s*"([^"]+)"'),
            ("excerpt", r'"description"\s*:\s*"([^"]+)"'),
            ("site_name", r'"publisher"\s*:\s*\{\s*(?:"@type"\s*:\s*"[^"]*"\s*,\s*)?"name"\s*:\s*"([^"]+)"'),
            ("date", r'"(?:datePublished|dateCreated|dateModified)"\s*:\s*"([^"]+)"'),
        ):
            if m := re.search(pattern, text):
                out[field] = m[1].strip()
        return out
    return {}


def unescape_basic(text: str) -> str:
    for name, sign in rules.BASIC_ENTITIES.items():
        if name != "amp":
            text = text.replace(f"&{name};", sign)
    text = re.sub(r"&#x([0-9a-f]{1,4});", lambda m: chr(int(m[1], 16)), text)
    text = re.sub(r"&#([0-9]{1,4});", lambda m: chr(int(m[1])), text)
    return text.replace("&amp;", "&")


def article_title(root: Node) -> str:
    """The title by the page's headline or title element, without the site's part."""
    headline = next((h for h in root.find_all("h1") if h.get("itemprop") == "headline"), None)
    if headline is not None and 15 < M.nbytes(t := headline.text()) < 150:
        return t
    element = root.find("title")
    original = title = element.raw_text().strip() if element is not None else ""
    words = lambda t: len(t.split())
    hierarchical = False
    if re.search(rules.TITLE_SEPARATORS, title):
        hierarchical = bool(re.search(r" [\\/>»] ", title))
        title = re.sub(r"(.*)[|\-\\/>»] .*", r"\1", title, flags=re.S)
        if words(title) < 3:
            title = re.sub(r"[^|\-\\/>»]*[|\-\\/>»](.*)", r"\1", original, flags=re.S)
    elif ": " in title:
        if not any(h.raw_text().strip() == title for h in root.find_all("h1", "h2")):
            title = original[original.rindex(":") + 1 :].strip()
            if words(title) < 3:
                before = original[: original.rindex(":")].strip()
                title = before if words(before) <= 5 else original
    elif title in ("", "null") or not 15 <= M.nbytes(title) <= 150:
        heads = root.find_all("h1")
        if len(heads) == 1:
            title = heads[0].text()
        elif headline is not None:
            title = headline.text()
    title = re.sub(r"\s{2,}", " ", title).strip()
    if words(title) <= 4 and (not hierarchical or words(title) != words(re.sub(r"[|\-\\/>»]+", "", original)) - 1):
        title = original or title
    return title


def metadata(root: Node) -> dict[str, str]:
    """title, byline, excerpt, site_name and date of a page."""
    linked, values = json_ld(root), {}
    for meta in root.find_all("meta"):
        content = meta.get("content").strip()
        if not content:
            continue
        if m := _META_PROPERTY.search(meta.get("property")):
            values[f"{m[1]}:{m[2]}"] = content
        elif m := _META_NAME.match(meta.get("name")):
            values[meta.get("name").lower().replace(" ", "").replace(".", ":")] = content

    def first(*names: str) -> str:
        return next((values[n] for n in names if values.get(n)), "")

    out = {
        "title": article_title(root) or linked.get("title", "") or first("dc:title", "dcterm:title", "og:title", "twitter:title", "title"),
        "byline": linked.get("byline", "") or first("dc:creator", "dcterm:creator", "author"),
        "excerpt": linked.get("excerpt", "") or first("dc:description", "dcterm:description", "og:description", "description", "twitter:description"),
        "site_name": linked.get("site_name", "") or first("og:site_name"),
        "date": linked.get("date", ""),
    }
    return {k: unescape_basic(v) for k, v in out.items()}


# Preparation --------------------------------------------------------------------------------------------------------
def unwrap_noscript_images(root: Node) -> None:
    for img in root.find_all("img"):
        if not any(k in ("src", "srcset", "data-src", "data-srcset") or _IMAGE.search(v) for k, v in img.attrs.items()):
            img.remove()
    for ns in root.find_all("noscript"):
        if ns.parent is None:
            continue
        inner = body_of(parse(ns.raw_text())) if not ns.elements() else ns
        if not M.single_image(inner):
            continue
        i = ns.index()
        before = next((c for c in reversed(ns.parent.children[:i]) if isinstance(c, Node)), None)
        if before is not None and M.single_image(before):
            old = before if before.tag == "img" else before.find("img")
            new = inner if inner.tag == "img" else inner.find("img")
            for k, v in old.attrs.items():
                if v and (k in ("src", "srcset") or _IMAGE.search(v)) and new.attrs.get(k) != v:
                    new.attrs[f"data-old-{k}" if k in new.attrs else k] = v
            new.remove()
            before.replace_with(new)
            ns.remove()


def prepare(root: Node) -> None:
    for n in root.find_all("script", "noscript", "style"):
        n.remove()
    _replace_breaks(body_of(root))
    for n in root.find_all("font"):
        n.tag = "span"


def _blank(c: Node | str) -> bool:
    return isinstance(c, str) and not c.strip()


def _replace_breaks(body: Node) -> None:
    """Two or more line breaks in a row begin a paragraph of the inline content that follows."""
    for br in body.find_all("br"):
        if br.parent is None:
            continue
        parent, i = br.parent, br.index()
        j, chain = i + 1, 1
        while j < len(parent.children):
            c = parent.children[j]
            if _blank(c):
                j += 1
            elif isinstance(c, Node) and c.tag == "br":
                chain, j = chain + 1, j + 1
            else:
                break
        if chain < 2:
            continue
        p, k = Node("p"), j
        while k < len(parent.children):
            c = parent.children[k]
            if isinstance(c, Node) and c.tag == "br":
                following = [x for x in parent.children[k + 1 :] if not _blank(x)]
                if following and isinstance(following[0], Node) and following[0].tag == "br":
                    break
            if not M.is_phrasing(c) and not (isinstance(c, Node) and c.tag == "a"):
                break
            k += 1
        moved = parent.children[j:k]
        for c in parent.children[i:k]:
            if isinstance(c, Node):
                c.parent = None
        parent.children[i:k] = [p]
        p.parent = parent
        while moved and _blank(moved[-1]):
            moved.pop()
        for c in moved:
            p.append(c)
        if parent.tag == "p":
            parent.tag = "div"


# Pruning and scoring ------------------------------------------------------------------------------------------------
class Page:
    """A page under extraction: its tree, what is known of it, and the rules in force."""

    def __init__(self, root: Node, meta: dict[str, str], options: ExtractOptions, deadline: float | None):
        self.root, self.meta, self.options, self.deadline = root, meta, options, deadline
        self.byline = ""
        self.flags = ALL_RULES

    def check_time(self) -> None:
        if self.deadline is not None and time.monotonic() > self.deadline:
            raise Timeout

    def is_byline(self, n: Node) -> bool:
        if self.byline or not (n.get("rel") == "author" or "author" in n.get("itemprop") or M.BYLINE.search(n.key)):
            return False
        text = n.text()
        if M.is_valid_byline(text):
            self.byline = text
            return True
        return False

    def prune(self, body: Node) -> list[Node]:
        """Removes what can't be content, in document order; the elements to score."""
        scored: list[Node] = []
        title_seen = False
        stack = [body]
        while stack:
            n = stack.pop()
            if n.parent is None:
                continue
            self.check_time()
            if n is not body:
                if not M.visible(n) or (n.get("aria-modal") == "true" and n.get("role") == "dialog") or self.is_byline(n):
                    n.remove()
                    continue
                if not title_seen and n.tag in ("h1", "h2") and M.similarity(n.text(), self.meta.get("title", "")) > rules.TITLE_SIMILARITY:
                    title_seen = True
                if self.flags & STRIP_UNLIKELY:
                    if n.tag not in ("body", "a") and M.is_unlikely(n) and not n.has_ancestor("table") and not n.has_ancestor("code"):
                        n.remove()
                        continue
                    if n.get("role") in rules.UNLIKELY_ROLES:
                        n.remove()
                        continue
                if n.tag in ("div", "section", "header", *M.HEADINGS) and M.without_content(n):
                    n.remove()
                    continue
            if n.tag in rules.TAGS_TO_SCORE:
                scored.append(n)
            if n.tag == "div":
                only = M.single_child(n, "p")
                if only is not None and M.link_density(n) < rules.PARAGRAPH_LINK_DENSITY:
                    n.replace_with(only)
                    n = only
                    scored.append(n)
                elif not M.has_block_child(n):
                    n.tag = "p"
                    scored.append(n)
            stack += reversed(n.elements())
        return scored

    def scores(self, scored: list[Node], body: Node) -> dict[int, tuple[Node, float]]:
        """Each candidate's score: its descendants' shares, its tag's and its class's."""
        out: dict[int, tuple[Node, float]] = {}
        for n in scored:
            if n.parent is None:
                continue
            text = n.text()
            size = M.nbytes(text)
            if size < rules.MIN_SCORED_BYTES:
                continue
            score = 1 + text.count(",") + min(size / rules.LENGTH_DIVISOR, rules.MAX_LENGTH_BONUS)
            for level, a in enumerate(n.ancestors()):
                if level >= rules.ANCESTORS or a.tag == "html":
                    break
                if id(a) not in out:
                    weight = M.class_weight(a) if self.flags & WEIGH_CLASSES else 0
                    out[id(a)] = (a, rules.INITIAL_SCORES.get(a.tag, 0.0) + weight)
                divider = 1 if level == 0 else 2 if level == 1 else 3 * level
                out[id(a)] = (a, out[id(a)][1] + score / divider)
        return out

    def choose(self, candidates: dict[int, tuple[Node, float]], body: Node) -> tuple[Node, float, dict[int, float]]:
        order = {id(n): i for i, n in enumerate([body, *body.walk()])}
        adjusted = {k: s * (1 - M.link_density(n)) for k, (n, s) in candidates.items()}
        best = min(adjusted, key=lambda k: (-adjusted[k], order.get(k, 0)))
        return candidates[best][0], adjusted[best], adjusted

    def gather(self, top: Node, score: float, adjusted: dict[int, float]) -> Node:
        """The top candidate with those siblings that belong to it."""
        out = Node("div", {"id": "readability-content"})
        if top.tag == "body" or top.parent is None:
            for c in list(top.children):
                out.append(c)
            return out
        threshold = max(rules.MIN_SIBLING_SCORE, score * rules.SIBLING_SHARE) if score <= 0 else score * rules.SIBLING_SHARE
        for s in top.parent.elements():
            keep = s is top
            if not keep:
                bonus = score * rules.SIBLING_SHARE if s.get("class") and s.get("class") == top.get("class") else 0
                if id(s) in adjusted and adjusted[id(s)] + bonus >= threshold:
                    keep = True
                elif s.tag == "p":
                    text = s.text()
                    size, density = M.nbytes(text), M.link_density(s, text)
                    keep = (size > rules.PARAGRAPH_BYTES and density < rules.PARAGRAPH_LINK_DENSITY) or (
                        0 < size < rules.PARAGRAPH_BYTES and density == 0 and bool(re.search(r"\.( |$)", text))
                    )
            if keep:
                if s.tag not in ("div", "article", "section", "p"):
                    s.tag = "div" if s.tag in ("body", "td", "center", "main") else s.tag
                out.append(s)
        return out

    # Cleaning -------------------------------------------------------------------------------------------------
    def clean_conditionally(self, e: Node, *tags: str) -> None:
        if not self.flags & CLEAN_CONDITIONALLY:
            return
        for n in reversed(e.find_all(*tags)):
            if n.parent is not None and not self._skipped(n) and self._removable(n):
                n.remove()

    def _skipped(self, n: Node) -> bool:
        is_data = lambda t: t.get("data-table") == "true"
        if n.tag == "table" and is_data(n) or n.has_ancestor("table", 0, is_data) or n.has_ancestor("code"):
            return True
        return n.tag == "table" and M.nbytes(n.text()) > rules.LAYOUT_TABLE_TEXT and M.link_density(n) < rules.HIGH_LINK_DENSITY

    def _removable(self, n: Node) -> bool:
        text = n.text()
        size = M.nbytes(text)
        if n.tag in ("h1", "h2", "h3") or size > 2 * rules.PARAGRAPH_BYTES:
            return False
        if n.tag in ("ul", "ol") and (len(n.find_all("li")) >= 3 or size > rules.PARAGRAPH_BYTES or M.list_has_content(n)):
            return False
        if text.count(",") >= rules.MIN_COMMAS or any(M.is_important_link(a.text()) for a in n.find_all("a")):
            return False
        weight = M.class_weight(n) if self.flags & WEIGH_CLASSES else 0
        paragraphs, images, items, inputs = (len(n.find_all(t)) for t in ("p", "img", "li", "input"))
        is_list = n.tag in ("ul", "ol")
        heads = sum(M.nbytes(h.text()) for h in n.find_all(*M.HEADINGS))
        heading_density = heads / size if size else 0.0
        embeds = sum(not any(M.VIDEOS.search(v) for v in x.attrs.values()) for x in n.find_all("object", "embed", "iframe"))
        density = M.link_density(n, text)
        in_figure = n.has_ancestor("figure", 3)
        removable = (
            (images > 1 and paragraphs / images < 0.5 and not in_figure)
            or (not is_list and items - 100 > paragraphs * 2 and size < 2 * rules.MIN_SCORED_BYTES)
            or inputs > paragraphs // 3
            or (not is_list and heading_density < rules.HEADING_DENSITY and size < rules.MIN_SCORED_BYTES and (images == 0 or images > 2) and not in_figure)
            or (not is_list and weight < rules.LOW_WEIGHT and density > rules.LOW_LINK_DENSITY)
            or (weight >= rules.LOW_WEIGHT and density > rules.HIGH_LINK_DENSITY and not (is_list and items > 4))
            or (embeds == 1 and size < rules.MIN_EMBED_BYTES)
            or embeds > 1
        )
        return removable and not (is_list and images == items and items > 0)

    def clean_headers(self, e: Node) -> None:
        """One heading that repeats the title, and one of each further text, stay."""
        title, seen, kept = self.meta.get("title", ""), set(), False
        for h in e.find_all("h1", "h2", "h3"):
            text = h.text()
            like_title = bool(title) and h.tag in ("h1", "h2") and (text.casefold() == title.casefold() or M.similarity(text, title) > rules.TITLE_SIMILARITY)
            if (like_title and kept) or text in seen:
                h.remove()
            elif text:
                kept |= like_title
                seen.add(text)

    def flatten_tables(self, e: Node) -> None:
        for t in e.find_all("table"):
            if t.parent is None:
                continue
            rows, _, cells = M.table_shape(t)
            if rows == 1 and cells == 1:
                cell = t.find("td", "th")
                cell.tag = "p" if all(M.is_phrasing(c) for c in cell.children) else "div"
                cell.attrs = {}
                t.replace_with(cell)
            elif t.get("data-table") == "false" and t.has_ancestor("table"):
                for n in t.find_all("tr", "td", "th", "tbody", "thead", "tfoot"):
                    n.tag = "div"
                t.tag = "div"

    def clean_article(self, e: Node) -> None:
        for t in e.find_all("table"):
            t.attrs["data-table"] = "true" if M.table_class(t) == "data" else "false"
        self.flatten_tables(e)
        _clean_styles(e)
        _fix_lazy_images(e)
        for a in e.find_all("a"):
            if a.get("data-type") in ("indexterm", "noteref"):
                a.remove()
        self.clean_conditionally(e, "form", "fieldset")
        self._drop(e, "object", "embed")
        self._drop(e, "footer", "aside", "nav", "link")
        self.clean_headers(e)
        for n in e.find_all("div", "p", "ul", "section", "span"):
            if n.parent is not None and M.SHARE.search(n.key) and M.nbytes(n.text()) < rules.CHAR_THRESHOLD:
                n.remove()
        self._drop(e, "iframe")
        self._drop(e, "input", "textarea", "select", "button")
        self.clean_headers(e)
        self.clean_conditionally(e, "table", "ul", "div")
        for p in e.find_all("p"):
            if p.parent is not None and not p.raw_text().strip() and not p.find("img", "embed", "object", "iframe", "video", "audio"):
                p.remove()
        for br in e.find_all("br"):
            if br.parent is not None:
                rest = [c for c in br.parent.children[br.index() + 1 :] if not _blank(c)]
                if rest and isinstance(rest[0], Node) and rest[0].tag == "p":
                    br.remove()

    @staticmethod
    def _drop(e: Node, *tags: str) -> None:
        for n in e.find_all(*tags):
            if n.parent is not None and not (n.tag in ("object", "embed", "iframe") and M.is_allowed_video(n)):
                n.remove()

    def attempt(self, root: Node) -> Node:
        body = body_of(root)
        candidates = self.scores(self.prune(body), body)
        if not candidates:
            out = Node("div", {"id": "readability-content"})
            for c in list(body.children):
                if isinstance(c, str) and c.strip():  # text alone is a paragraph
                    p = Node("p")
                    p.append(c.strip())
                    c = p
                out.append(c)
        else:
            out = self.gather(*self.choose(candidates, body))
        self.clean_article(out)
        return out

    def article(self) -> Node:
        """The article, by the strictest rules that give enough text; if none do, by those that give most."""
        best: tuple[int, Node] | None = None
        for dropped in (0, STRIP_UNLIKELY, STRIP_UNLIKELY | WEIGH_CLASSES, ALL_RULES):
            self.flags = ALL_RULES & ~dropped
            last = dropped == ALL_RULES
            out = self.attempt(self.root if last else self.root.clone())
            size = M.nbytes(out.text())
            if size >= self.options.char_threshold:
                return out
            if best is None or size > best[0]:
                best = (size, out)
        return best[1]


def _clean_styles(e: Node) -> None:
    stack = [e]
    while stack:
        n = stack.pop()
        if n.tag == "svg":
            continue
        for k in rules.PRESENTATIONAL:
            n.attrs.pop(k, None)
        if n.tag in rules.SIZED_ELEMENTS:
            n.attrs.pop("width", None)
            n.attrs.pop("height", None)
        stack += n.elements()


def _fix_lazy_images(e: Node) -> None:
    for n in e.find_all("img", "picture", "figure"):
        src = n.get("src")
        if m := re.match(r"data:\s*([^\s;,]+)\s*;\s*base64\s*,", src):
            others = any(k != "src" and _IMAGE.search(v) for k, v in n.attrs.items())
            if m[1] != "image/svg+xml" and others and len(src) - m.end() < 133:
                del n.attrs["src"]
        if (n.get("src") or n.get("srcset")) and "lazy" not in n.get("class").lower():
            continue
        for k, v in list(n.attrs.items()):
            if k in ("src", "srcset", "alt"):
                continue
            target = "srcset" if re.search(r"\.(jpg|jpeg|png|webp)\s+\d", v) else "src" if re.match(r"^\s*\S+\.(jpg|jpeg|png|webp)\S*\s*$", v) else ""
            if target and n.tag in ("img", "picture"):
                n.attrs[target] = v


def _fix_links(e: Node, base: str) -> None:
    for a in e.find_all("a"):
        href = a.get("href")
        if href.startswith("javascript:"):
            if len(a.children) == 1 and isinstance(a.children[0], str):
                a.replace_with(a.children[0])
            else:
                a.tag, a.attrs = "span", {}
        elif href and base and not href.startswith("#"):
            a.attrs["href"] = urljoin(base, href)
    if base:
        for n in e.find_all("img", "picture", "figure", "video", "audio", "source"):
            for k in ("src", "poster"):
                if n.get(k):
                    n.attrs[k] = urljoin(base, n.get(k))
            if n.get("srcset"):
                n.attrs["srcset"] = re.sub(r"(\S+)(\s+[\d.]+[xw])?(\s*(?:,|$))", lambda m: urljoin(base, m[1]) + (m[2] or "") + m[3], n.get("srcset"))


def _append_links(e: Node, links: list[Node]) -> None:
    """Puts links that the article doesn't hold, each address once, into a section at its end."""
    seen, section = {a.get("href") for a in e.find_all("a")}, Node("div")
    heading = Node("h2")
    heading.append("Additional Links")
    section.append(heading)
    for a in links:
        if a.get("href") not in seen:
            seen.add(a.get("href"))
            p = Node("p")
            p.append(a)
            section.append(p)
    if len(section.children) > 1:
        e.append(section)


def _simplify(e: Node) -> None:
    for n in e.find_all("div", "section"):
        if n.parent is None or n.get("id").startswith("readability"):
            continue
        if M.without_content(n) and not n.find("img", "video", "audio", "iframe", "object", "embed"):
            n.remove()
            continue
        only = M.single_child(n, "div") or M.single_child(n, "section")
        if only is not None:
            only.attrs = {**n.attrs, **only.attrs}
            n.replace_with(only)


def _clean_classes(e: Node, kept: tuple[str, ...]) -> None:
    for n in [e, *e.walk()]:
        n.attrs.pop("data-table", None)
        if "class" in n.attrs:
            own = [c for c in n.get("class").split() if c in kept]
            if own:
                n.attrs["class"] = " ".join(own)
            else:
                del n.attrs["class"]


# Output -------------------------------------------------------------------------------------------------------------
_NOT_PRINTABLE = re.compile("[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f-\\x9f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff\\ue000-\\uf8ff]")


def normalize_text(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        for k, v in rules.REPLACEMENTS.items():
            if k in text:
                text = text.replace(k, v)
    text = _NOT_PRINTABLE.sub("", text)
    if "  " in text or text[:1] == " " or text[-1:].isspace():
        text = re.sub(r"\s+", " ", text).strip()
    return text


def node_digest(n: Node) -> str:
    """SHA-256 of a paragraph's or item's normalised text; of another element, of its children's digests."""
    if n.tag in ("p", "li"):
        text = normalize_text(n.text())
        return hashlib.sha256(text.encode()).hexdigest() if text else ""
    joined = "".join(node_digest(c) for c in n.elements())
    return hashlib.sha256(joined.encode()).hexdigest() if joined else ""


def index_nodes(root: Node, index: str = "0") -> Iterator[tuple[Node, str]]:
    """Each element with its place: the root's index, then the numbers of siblings from 1."""
    yield root, index
    for i, c in enumerate(root.elements()):
        yield from index_nodes(c, f"{index}.{i + 1}")


def plain_content(article: Node, digests: bool = False, indexes: bool = False) -> str:
    """The article without attributes, text normalised; on request with node indexes and content digests."""
    plain = Node("div")
    for c in article.clone().children:
        plain.append(c)
    links = {id(a): a.get("href") for a in plain.find_all("a")}
    for n in plain.walk():
        keep = {"href": links[id(n)]} if id(n) in links and links[id(n)] else {k: n.attrs[k] for k in ("src", "alt") if n.tag == "img" and k in n.attrs}
        n.attrs = keep
    if indexes:
        for n, i in index_nodes(plain):
            n.attrs["data-node-index"] = i
    if digests:
        for n in plain.find_all("p", "li"):
            n.attrs["data-content-digest"] = node_digest(n)
    return re.sub(r"\s*<\s*(/?[a-zA-Z][^>]*?)\s*>", r"<\1>", normalize_text(plain.outer_html())).replace("&#34;", '"')


def text_blocks(article: Node, indexes: bool = False, digests: bool = False) -> list[dict]:
    """Paragraphs and list items with text, in document order."""
    out = []
    for n, i in index_nodes(article):
        if n.tag in ("p", "li") and (text := normalize_text(n.text())):
            out.append({"text": text, "node_index": i if indexes else None, "content_digest": node_digest(n) if digests else None})
    return out


def error_page(title: str, message: str) -> str:
    return f'<h1>{escape(title)}</h1><p>{escape(message)}</p><a href="/">Return to homepage</a>'


def _instant(value: str) -> dt.datetime | None:
    try:
        t = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return None
    return t.astimezone(dt.timezone.utc) if t.tzinfo else None


EMPTY = dict.fromkeys(ARTICLE.fieldNames())


def extract_page(source: str | None, options: ExtractOptions = ExtractOptions(), url: str | None = None) -> dict:
    """The article record of a page. Null gives a record of nulls with an error; a page that fails gives its error in place of content."""
    if source is None:
        return {**EMPTY, "error": "[validation:extract] no page"}
    if options.max_buffer:
        source = source[: options.max_buffer]
    if options.max_elements and len(re.findall("<[a-zA-Z]", source)) > options.max_elements:
        return {**EMPTY, "error": "[validation:extract] document too large"}
    deadline = time.monotonic() + options.timeout if options.timeout else None
    try:
        root = parse(source)
        lang, base = root.get("lang") or None, next((b.get("href") for b in head_of(root).find_all("base")), "") or url or ""
        unwrap_noscript_images(root)
        meta = metadata(root)
        body_text = body_of(root).raw_text().lower()
        prepare(root)
        kept = [a.clone() for a in body_of(root).find_all("a") if M.is_important_link(a.text())] if options.preserve_important_links else []
        page = Page(root, meta, options, deadline)
        article = page.article()
        _append_links(article, kept)
        _fix_links(article, base)
        _simplify(article)
        for f in [n for n in article.walk() if n.tag == "footer" or "footer" in n.get("class").split()]:
            f.remove()
        excerpt = meta["excerpt"] or next((t for p in article.find_all("p") if (t := p.text())), "")
        _clean_classes(article, options.kept_classes)
        title, text = meta["title"], article.text()
        kind = options.content_type or 2
        lowered = title.lower()
        content = article.inner_html() if text or article.find("img", "video") else ""
        wrapped = f'<div id="readability-page-1" class="page">{content}</div>' if content else ""
        told = any(w in lowered for w in ("not found", "error page")) or any(w in body_text for w in ("page not found", "404 error", "error 404"))
        if M.nbytes(text) < options.char_threshold and told:
            message = next((t for n in reversed(article.find_all("p", *M.HEADINGS)) if (t := n.text()) and t != title), "The page could not be found.")
            wrapped, kind = error_page(title, message), 4
            article = body_of(parse(wrapped))
        elif not content and title:
            if any(w in lowered for w in ("not found", "error", "404")):
                wrapped, kind = error_page(title, "The page could not be found."), 4
            else:
                wrapped = f"<h1>{escape(title)}</h1><p>No content available</p>"
            article = body_of(parse(wrapped))
        blocks = text_blocks(article, options.node_indexes, options.content_digests) if content or wrapped else []
        if not blocks and title:
            blocks = [{"text": title, "node_index": None, "content_digest": None}]
        date = _instant(meta["date"]) if meta["date"] else None
        if date is None and options.extended_date:
            from pagewright.operators.dates import page_date

            date = page_date(source)
        return {
            "title": title or None, "byline": meta["byline"] or page.byline or None, "date": date, "content": wrapped or None,
            "plain_content": plain_content(article, options.content_digests, options.node_indexes) if wrapped else None,
            "plain_text": blocks, "content_type": kind, "excerpt": excerpt or None, "site_name": meta["site_name"] or None, "lang": lang,
            "text_content": article.text() or None, "length": len(article.text()), "error": None,
        }
    except Timeout:
        return {**EMPTY, "error": f"[timeout:extract] timed out after {options.timeout:g} s"}
    except RecursionError:
        return {**EMPTY, "error": "[extraction:extract] the page is nested too deeply"}


def extract_articles(pages: DataFrame, options: ExtractOptions = ExtractOptions(), html: str = "html", url: str | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep and the article record's fields, for each page. Other columns aren't read; works alike on tables and streams."""
    columns = [*keep, html, *([url] if url and url not in keep else [])]
    schema = StructType([*[pages.schema[c] for c in keep], *ARTICLE.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            urls = pdf[url] if url else [None] * len(pdf)
            rows = [extract_page(h, options, u) for h, u in zip(pdf[html], urls)]
            out = pd.DataFrame(rows, columns=ARTICLE.fieldNames())
            out["date"] = pd.to_datetime(out["date"], utc=True)
            for c in ("content_type", "length"):
                out[c] = out[c].astype("Int32")
            for i, c in enumerate(keep):
                out.insert(i, c, pdf[c].to_numpy())
            yield out

    return pages.select(*columns).mapInPandas(run, schema)


@F.pandas_udf(ARTICLE)
def extract_article(html: pd.Series) -> pd.DataFrame:
    """The article record of a page as a column."""
    out = pd.DataFrame([extract_page(h) for h in html], columns=ARTICLE.fieldNames())
    out["date"] = pd.to_datetime(out["date"], utc=True)
    for c in ("content_type", "length"):
        out[c] = out[c].astype("Int32")
    return out


@F.udtf(returnType="block_no int, text string, node_index string, content_digest string", useArrow=False)
class TextBlocks:
    """The blocks of the article that a page holds, as rows."""

    def eval(self, html: str):
        for i, b in enumerate(extract_page(html)["plain_text"] or []):
            yield i, b["text"], b["node_index"], b["content_digest"]


def register(spark: SparkSession) -> None:
    """extract_article and the table function text_blocks for SQL; nodes.register adds that of nodes."""
    spark.udf.register("extract_article", extract_article)
    spark.udtf.register("text_blocks", TextBlocks)


def article_column(html: str = "html") -> Column:
    return extract_article(F.col(html))


__all__ = ["ALL_RULES", "Page", "StructField", "extract_article", "extract_articles", "extract_page", "metadata", "plain_content", "register", "text_blocks"]
