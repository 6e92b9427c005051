"""Simplification of markup by a list of steps, and repair and enrichment of its structure. All steps change a tree in place and are row-local."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions import rules
from pagewright.operators import measures as M
from pagewright.operators.dom import VOID, Node, body_of, parse
from pagewright.operators.extract import index_nodes, node_digest, normalize_text

#: Elements that go with their contents, that give way to their contents, that are written with signs, and that are known.
DELETED = frozenset(
    "button datalist fieldset form input label legend meter optgroup option output progress select textarea area img map picture source audio track video "
    "embed iframe math object param svg details dialog summary canvas noscript script template data link style nav".split()
)
UNWRAPPED = frozenset("a abbr address b bdi bdo center cite code del dfn em i ins kbs mark rb ruby rp rt rtc s samp small span strong time u var wbr".split())
SIGNED = {"q": ('"', '"'), "sub": ("_", ""), "sup": ("^", "")}
BLOCKS = frozenset("article aside blockquote caption colgroup col div dl dt dd figure figcaption footer h1 h2 h3 h4 h5 h6 header li main ol p pre section table tbody td tfoot th thead tr ul".split())
KNOWN = BLOCKS | UNWRAPPED | DELETED | frozenset(SIGNED) | frozenset("html head body meta link base title br hr".split())
#: Page chrome by tag, by part of a class or identifier, and by whole class.
CHROME, CHROME_PARTS, CHROME_CLASSES = frozenset("nav footer header aside".split()), ("nav", "menu", "sidebar", "footer", "header"), frozenset(("ad", "advertisement"))
NOT_IN_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
    "pre section table ul".split()
)
CONTAINERS = frozenset("article aside blockquote div footer header li main section td th dd body".split())
KEPT_DATA = frozenset(("data-src", "data-srcset", "data-content-digest", "data-node-index"))


@dataclass(frozen=True)
class Steps:
    """Steps of a simplification, in the order in which they run."""

    remove_metadata: bool = True
    remove_blacklist: bool = True
    unwrap: bool = True
    signs: bool = True
    unknown: bool = True
    consolidate: bool = True
    remove_empty: bool = True
    unnest_paragraphs: bool = True
    break_paragraphs: bool = True
    wrap_text: bool = True
    strip_attributes: bool = True
    normalize: bool = True
    digests: bool = False
    indexes: bool = False


def _each(e: Node, tags: frozenset[str], change: Callable[[Node], None]) -> None:
    for n in e.find_all(*tags):
        if n.parent is not None:
            change(n)


def remove_metadata(e: Node) -> None:
    _each(e, frozenset(("#comment",)), Node.remove)


def strip_attributes(e: Node) -> None:
    for n in [e, *e.walk()]:
        n.attrs = {k: v for k, v in n.attrs.items() if k not in ("class", "style")}


def remove_blacklist(e: Node) -> None:
    """Elements of no text, page chrome by tag or class, and elements that are mostly links."""
    _each(e, DELETED | CHROME, Node.remove)
    for n in list(e.walk()):
        if n.parent is not None and (any(w in n.key for w in CHROME_PARTS) or CHROME_CLASSES & set(n.get("class").split()) or (n.text() and M.link_density(n) > 0.5)):
            n.remove()


def unwrap_elements(e: Node) -> None:
    _each(e, UNWRAPPED, Node.unwrap)


def write_signs(e: Node) -> None:
    def change(n: Node) -> None:
        before, after = SIGNED[n.tag]
        n.children = [before, *n.children, after]
        n.unwrap()

    _each(e, frozenset(SIGNED), change)


def unwrap_unknown(e: Node) -> None:
    for n in e.find_all(*{x.tag for x in e.walk()} - KNOWN):
        if n.parent is not None:
            n.unwrap()


def consolidate_text(e: Node) -> None:
    """Neighbouring texts become one."""
    for n in [e, *e.walk()]:
        own, n.children = n.children, []
        for c in own:
            if isinstance(c, str) and n.children and isinstance(n.children[-1], str):
                n.children[-1] += c
            elif c != "":
                n.children.append(c)


def remove_empty(e: Node) -> None:
    """Elements without text or void elements, from the innermost out; blank texts between blocks."""
    for n in reversed(list(e.walk())):
        if n.parent is not None and n.tag not in VOID and not n.raw_text().strip() and not any(x.tag in VOID for x in n.walk()):
            n.remove()
    for n in [e, *e.walk()]:
        if any(isinstance(c, Node) and c.tag in BLOCKS for c in n.children):
            n.children = [c for c in n.children if not isinstance(c, str) or c.strip()]


def unnest_paragraphs(e: Node) -> None:
    """A paragraph with a block inside is cut around the block."""
    for p in e.find_all("p"):
        if p.parent is None or not any(isinstance(c, Node) and c.tag in NOT_IN_P for c in p.children):
            continue
        _replace_by_runs(p, lambda c: isinstance(c, Node) and c.tag in NOT_IN_P, keep=True)


def _replace_by_runs(p: Node, cut: Callable[[Node | str], bool], keep: bool) -> None:
    """Puts, in order, a paragraph for each run of children between cuts, and the cuts themselves if they are kept."""
    out: list[Node] = []
    run: list[Node | str] = []

    def close() -> None:
        if any(not isinstance(c, str) or c.strip() for c in run):
            q = Node("p", dict(p.attrs))
            for c in run:
                if isinstance(c, Node):
                    c.parent = None
                q.append(c)
            out.append(q)
        run.clear()

    for c in list(p.children):
        if cut(c):
            close()
            if keep:
                c.parent = None
                out.append(c)
        else:
            run.append(c)
    close()
    p.children = []
    p.replace_with(*out)


def break_paragraphs(e: Node) -> None:
    """Two line breaks in a row and rules part paragraphs; a single line break is a blank."""
    for p in e.find_all("p"):
        if p.parent is None:
            continue
        own = [c for i, c in enumerate(p.children) if not (isinstance(c, str) and not c.strip() and 0 < i < len(p.children) - 1)]
        marks: list[Node | str] = []
        for c in own:
            is_br = isinstance(c, Node) and c.tag == "br"
            if is_br and marks and isinstance(marks[-1], Node) and marks[-1].tag in ("br", "hr"):
                marks[-1].tag = "hr"
                continue
            marks.append(c)
        p.children = [" " if isinstance(c, Node) and c.tag == "br" else c for c in marks]
        if any(isinstance(c, Node) and c.tag == "hr" for c in p.children):
            _replace_by_runs(p, lambda c: isinstance(c, Node) and c.tag == "hr", keep=False)


def wrap_text(e: Node) -> None:
    """Text that stands bare beside blocks goes into paragraphs; a paragraph alone in an item or cell gives way to its contents."""
    for n in [e, *e.walk()]:
        if n.tag in CONTAINERS and any(isinstance(c, Node) and c.tag in BLOCKS for c in n.children):
            out: list[Node | str] = []
            for c in list(n.children):
                inline = isinstance(c, str) or c.tag not in BLOCKS | frozenset(("hr",))
                if inline and (not isinstance(c, str) or c.strip()):
                    if not (out and isinstance(out[-1], Node) and out[-1].attrs.get("new") == "p"):
                        out.append(Node("p", {"new": "p"}))
                        out[-1].parent = n
                    if isinstance(c, Node):
                        c.parent = None
                    out[-1].append(c)
                elif not inline:
                    out.append(c)
            for c in out:
                if isinstance(c, Node):
                    c.attrs.pop("new", None)
            n.children = out
    for n in e.find_all("li", "td", "th", "dd"):
        only = M.single_child(n, "p")
        if only is not None:
            only.unwrap()


def normalize_strings(e: Node) -> None:
    for n in [e, *e.walk()]:
        n.children = [normalize_text(c) if isinstance(c, str) and c.strip() else (" " if isinstance(c, str) and c else c) for c in n.children]


def simplify(source: str, steps: Steps = Steps()) -> str:
    """The simplified markup of a page in a div."""
    body = body_of(parse(source, comments=True))
    plan = (
        (steps.remove_metadata, remove_metadata), (steps.remove_blacklist, remove_blacklist), (steps.unwrap, unwrap_elements), (steps.signs, write_signs),
        (steps.unknown, unwrap_unknown), (steps.consolidate, consolidate_text), (steps.unnest_paragraphs, unnest_paragraphs), (steps.break_paragraphs, break_paragraphs),
        (steps.remove_empty, remove_empty), (steps.wrap_text, wrap_text), (steps.strip_attributes, strip_attributes), (steps.normalize, normalize_strings),
    )
    for wanted, step in plan:
        if wanted:
            step(body)
    body.tag, body.attrs = "div", {}
    if steps.indexes:
        for n, i in index_nodes(body):
            n.attrs["data-node-index"] = i
    if steps.digests:
        for n in [body, *body.walk()]:
            n.attrs["data-content-digest"] = node_digest(n)
    return body.outer_html()


# Structure ------------------------------------------------------------------------------------------------------------
def preserve_headings(e: Node) -> None:
    """A heading goes down at most one level below the one before."""
    last = 0
    for h in e.find_all(*M.HEADINGS):
        level = int(h.tag[1])
        if last and level > last + 1:
            h.tag = f"h{last + 1}"
        last = int(h.tag[1])


def _wrap_orphans(e: Node, tags: tuple[str, ...], parents: tuple[str, ...], wrapper: str) -> None:
    for n in e.find_all(*tags):
        if n.parent is None or n.parent.tag in parents:
            continue
        before = n.parent.children[n.index() - 1] if n.index() else None
        if isinstance(before, Node) and before.attrs.get("new") == wrapper:
            before.append(n)
        else:
            w = Node(wrapper, {"new": wrapper})
            n.replace_with(w)
            w.append(n)
    for n in e.find_all(wrapper):
        n.attrs.pop("new", None)


def preserve_lists(e: Node) -> None:
    _wrap_orphans(e, ("li",), ("ul", "ol", "menu"), "ul")


def preserve_tables(e: Node) -> None:
    _wrap_orphans(e, ("td", "th"), ("tr",), "tr")
    _wrap_orphans(e, ("tr",), ("table", "tbody", "thead", "tfoot"), "table")


def preserve_structure(source: str) -> str:
    body = body_of(parse(source))
    for step in (preserve_headings, preserve_lists, preserve_tables):
        step(body)
    return body.inner_html()


def is_content_area(n: Node) -> bool:
    named = rules.IMAGE_AREA_PART in n.get("id") or rules.IMAGE_AREA_PART in n.get("class")
    return n.tag in rules.IMAGE_AREA_TAGS or named or bool(set(rules.IMAGE_AREA_CLASSES) & set(n.get("class").split()))


# Images ---------------------------------------------------------------------------------------------------------------
def is_relevant_image(n: Node) -> bool:
    """Whether an image belongs to the content; the first rule that tells."""
    size = [int(v) for k in ("width", "height") if (v := n.get(k)).isdigit()]
    if len(size) == 2 and all(0 < v < 100 for v in size):
        return False
    if any(w in n.get("src").lower() for w in rules.DECORATIVE_IMAGES):
        return False
    alt = n.get("alt")
    if alt and alt.lower() not in rules.GENERIC_ALT:
        return True
    if any(a.tag == "figure" and a.find("figcaption") is not None for a in n.ancestors()):
        return True
    if any(is_content_area(a) for a in n.ancestors()):
        return True
    return not (n.get("role") == "presentation" or set(rules.BACKGROUND_CLASSES) & set(n.get("class").split()) or "background-image" in n.get("style"))


def image_caption(n: Node) -> str:
    figure = next((a for a in n.ancestors() if a.tag == "figure"), None)
    caption = figure.find("figcaption") if figure is not None else None
    return (caption.text() if caption is not None else "") or n.get("alt") or n.get("title") or n.get("aria-label")


def image_metadata(n: Node) -> dict[str, str]:
    own = {k: n.get(k) for k in ("src", "width", "height", "alt", "title")}
    return {k: v for k, v in {**own, "caption": image_caption(n)}.items() if v}


def enhance_images(e: Node) -> None:
    """Irrelevant images go; others load lazily and carry their caption as alternative text and title."""
    for n in e.find_all("img"):
        if n.parent is None:
            continue
        if not is_relevant_image(n):
            n.remove()
            continue
        caption = image_caption(n)
        n.attrs.setdefault("loading", "lazy")
        if caption:
            n.attrs["alt"] = n.get("alt") or caption
            n.attrs.setdefault("title", caption)
        n.attrs["class"] = " ".join(dict.fromkeys([*n.get("class").split(), "img-fluid"]))


def lazy_images(e: Node) -> None:
    for n in e.find_all("img"):
        n.attrs.setdefault("loading", "lazy")


def optimise(e: Node) -> None:
    """Without comments, event handlers and data attributes but the few that are used."""
    remove_metadata(e)
    for n in e.walk():
        n.attrs = {k: v for k, v in n.attrs.items() if not k.startswith("on") and (not k.startswith("data-") or k in KEPT_DATA)}


# Cascades -------------------------------------------------------------------------------------------------------------
def repair(source: str) -> str:
    """Markup with the html, head and body that it lacks."""
    if not re.search("<body", source, re.I):
        source = f"<body>{source}</body>"
    if not re.search("<head", source, re.I):
        source = f"<head></head>{source}"
    return source if re.search("<html", source, re.I) else f"<html>{source}</html>"


def main_with_fallback(source: str, least: int = 100) -> Node:
    """The first of article, main, marked content and paragraphs that has enough text, else the body."""
    body = body_of(parse(repair(source)))
    tries = [body.find("article"), body.find("main"), next((n for n in body.walk() if n.tag == "div" and any(w in n.key.lower() for w in ("content", "article", "post"))), None)]
    for n in tries:
        if n is not None and M.nbytes(n.text()) > least:
            return n
    return body


def text_with_fallback(source: str, least: int = 100) -> str:
    text = main_with_fallback(source, least).text()
    return text or re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", source)).strip()


def list_paragraph_blocks(e: Node) -> list[str]:
    """Texts of paragraphs in order, each list as one text of starred items."""
    out = []
    for n in e.walk():
        if n.tag in ("ul", "ol"):
            out.append("".join(f"* {li.text()}, " for li in n.find_all("li") if li.text()))
        elif n.tag == "p" and not n.has_ancestor("ul") and not n.has_ancestor("ol") and n.text():
            out.append(n.text())
    return [t for t in out if t]


@F.pandas_udf(StringType())
def simplified(html: pd.Series) -> pd.Series:
    return html.map(simplify, na_action="ignore")


@F.pandas_udf(StringType())
def restructured(html: pd.Series) -> pd.Series:
    return html.map(preserve_structure, na_action="ignore")
