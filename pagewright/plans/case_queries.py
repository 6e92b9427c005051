"""Small fixed tables of cases: each query runs an operator over inputs written here, and its SQL states what must come out. The expected values are
those that the rules and published unit vectors demand, worked out by hand; no value is taken from a run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import extract as X
from pagewright.operators import measures as M
from pagewright.operators import metadata as MD
from pagewright.operators import nodes as N
from pagewright.operators import simplify as S
from pagewright.operators.dates import page_byline
from pagewright.operators.dom import Node, body_of, parse
from pagewright.operators.pages import page_byline_column, page_date_column, page_title_column
from pagewright.options import ExtractOptions
from pagewright.sources.files import output_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _sql(columns: str, rows: list[tuple]) -> str:
    """SQL of a fixed table; columns: names with their types, as in name VARCHAR."""
    names = [c.strip().split(" ") for c in columns.split(",")]
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in names)
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({', '.join(n for n, _ in names)})"


def _inputs(spark: SparkSession, cases: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(c[0], c[1]) for c in cases], "name string, input string")


def _mapped(name: str, kind: str, duck: str, cases: list[tuple], value: Callable) -> None:
    """Registers a query of (name, value): a function of each case's input, run by the executors; with the SQL of what is expected."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"name": pdf["name"], "value": pd.Series([value(n, i) for n, i in zip(pdf["name"], pdf["input"])], dtype=object)})

        return _inputs(spark, cases).mapInPandas(run, f"name string, value {kind}")

    query.__name__, query.__doc__ = name, value.__doc__
    QUERIES[name] = query
    ORACLES[name] = _sql(f"name VARCHAR, value {duck}", [(c[0], c[-1]) for c in cases])


def _columns(name: str, columns: str, cases: list[tuple], expected: list[tuple], frame: Callable[[DataFrame], DataFrame]) -> None:
    """Registers a query that gives a table from the table of inputs, with the SQL of what is expected."""
    QUERIES[name] = lambda spark, d: frame(_inputs(spark, cases))
    ORACLES[name] = _sql(columns, expected)


def _body(source: str, step: Callable[[Node], object]) -> str:
    body = body_of(parse(source))
    step(body)
    return body.inner_html()


def _first(source: str, tag: str) -> Node:
    return parse(source).find(tag)


# Trees and steps ------------------------------------------------------------------------------------------------------
TREES = [
    ("paragraphs", "<p>a<p>b", "<p>a</p><p>b</p>"),
    ("items", "<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
    ("implied table parts", "<table><td>1<td>2<tr><td>3</table>x", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>x"),
    ("text out of a table", "<table>x<tr><td>1</table>", "x<table><tbody><tr><td>1</td></tr></tbody></table>"),
    ("element out of a table", "<table><tr><p>x</p><td>1</td></table>", "<p>x</p><table><tbody><tr><td>1</td></tr></tbody></table>"),
    ("stray end", "a</div>b", "ab"),
    ("script text", "<div><script>'</p>'</script>x</div>", "<div><script>'</p>'</script>x</div>"),
    ("entities", "x &amp; y &lt;b&gt;", "x &amp; y &lt;b&gt;"),
    ("void elements", "a<br>b<img src=x>", 'a<br/>b<img src="x"/>'),
    ("definitions", "<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("heading closes paragraph", "<p>a<h2>b</h2>", "<p>a</p><h2>b</h2>"),
    ("end of paragraph alone", "</p>a", "<p></p>a"),
    ("formatting across a block", "<b>a<p>b</b>c</p>d", "<b>a</b><p><b>b</b>c</p>d"),
    ("link across a block", '<a href="/x"><div>b</a>c</div>', '<a href="/x"></a><div><a href="/x">b</a>c</div>'),
    ("formatting across paragraphs", "<p>a<b>b<p>c</b>d", "<p>a<b>b</b></p><p><b>c</b>d</p>"),
]
_mapped("tree_cases", "string", "VARCHAR", TREES, lambda n, i: _body(i, lambda b: None))


def _pruned(source: str, title: str = "") -> str:
    root = parse(source)
    X.Page(root, {"title": title}, ExtractOptions(), None).prune(body_of(root))
    return body_of(root).inner_html()


def _article_step(step: str) -> Callable[[Node], object]:
    def run(body: Node) -> None:
        getattr(X.Page(Node("html"), {"title": "A long title of the page"}, ExtractOptions(), None), step)(body)

    return run


def _whole(step: Callable[[Node], object]) -> Callable[[str], str]:
    def run(source: str) -> str:
        root = parse(source)
        step(root)
        return body_of(root).inner_html()

    return run


#: By the part of a case's name before the colon.
STEPS: dict[str, Callable[[str], str]] = {
    "prepare": _whole(X.prepare),
    "noscript": _whole(X.unwrap_noscript_images),
    "prune": _pruned,
    "styles": lambda s: _body(s, X._clean_styles),
    "lazy": lambda s: _body(s, X._fix_lazy_images),
    "links": lambda s: _body(s, lambda b: X._fix_links(b, "https://a.example/dir/page.html")),
    "nested": lambda s: _body(s, X._simplify),
    "classes": lambda s: _body(s, lambda b: X._clean_classes(b, ("page",))),
    "headers": lambda s: _body(s, _article_step("clean_headers")),
    "clean": lambda s: _body(s, _article_step("clean_article")),
    "headings": lambda s: _body(s, S.preserve_headings),
    "lists": lambda s: _body(s, S.preserve_lists),
    "tables": lambda s: _body(s, S.preserve_tables),
    "optimise": lambda s: _body(s, S.optimise),
    "load": lambda s: _body(s, S.lazy_images),
    "repair": S.repair,
    "fallback": S.text_with_fallback,
    "listed": lambda s: " / ".join(S.list_paragraph_blocks(body_of(parse(s)))),
    "main": lambda s: S.main_with_fallback(s).tag,
}
_LONG = "This paragraph of the page is long enough to be kept whatever else is said about it. " * 2
STEP_CASES = [
    ("prepare: scripts", "<p>a</p><script>x</script><noscript>y</noscript><style>z</style>", "<p>a</p>"),
    ("prepare: breaks", "<div>a<br><br>b<br>c</div>", "<div>a<p>b<br/>c</p></div>"),
    ("prepare: one break", "<div>a<br>b</div>", "<div>a<br/>b</div>"),
    ("prepare: breaks in a paragraph", "<p>a<br><br>b</p>", "<div>a<p>b</p></div>"),
    ("prepare: font", "<font>a</font>", "<span>a</span>"),
    ("noscript: image", '<img src="small.jpg"><noscript><img src="large.jpg"></noscript>', '<img src="large.jpg" data-old-src="small.jpg"/>'),
    ("noscript: image without source", '<p>x</p><img class="a">', "<p>x</p>"),
    ("prune: display", '<p>a</p><p style="display:none">b</p>', "<p>a</p>"),
    ("prune: hidden", "<p>a</p><p hidden>b</p>", "<p>a</p>"),
    ("prune: aria-hidden", '<p>a</p><div aria-hidden="true"><p>b</p></div>', "<p>a</p>"),
    ("prune: dialog", '<p>a</p><div role="dialog" aria-modal="true"><p>b</p></div>', "<p>a</p>"),
    ("prune: unlikely", '<p>a</p><div class="sidebar"><p>b</p></div>', "<p>a</p>"),
    ("prune: maybe", '<p>a</p><div class="sidebar article"><p>b</p><p>c</p></div>', '<p>a</p><div class="sidebar article"><p>b</p><p>c</p></div>'),
    ("prune: in a table", '<table><tr><td class="sidebar"><p>b</p><p>c</p></td></tr></table>', '<table><tbody><tr><td class="sidebar"><p>b</p><p>c</p></td></tr></tbody></table>'),
    ("prune: role", '<p>a</p><ul role="menu"><li>b</li></ul>', "<p>a</p>"),
    ("prune: byline", '<p class="byline">By Ann Lee</p><p>a</p>', "<p>a</p>"),
    ("prune: empty", "<p>a</p><div><br></div><section></section>", "<p>a</p>"),
    ("prune: div of text", "<div>a b</div>", "<p>a b</p>"),
    ("prune: div of a paragraph", "<div><p>a b</p></div>", "<p>a b</p>"),
    ("styles: presentation", '<p style="x" align="left" class="c">a</p><table width="9" border="0"><tr><td width="3">b</td></tr></table>', '<p class="c">a</p><table><tbody><tr><td>b</td></tr></tbody></table>'),
    ("styles: image keeps its size", '<img width="9" src="a.png" style="x">', '<img width="9" src="a.png"/>'),
    ("lazy: source", '<img class="lazy" data-src="real.jpg">', '<img class="lazy" data-src="real.jpg" src="real.jpg"/>'),
    ("lazy: source set", '<img data-set="a.jpg 1x, b.jpg 2x">', '<img data-set="a.jpg 1x, b.jpg 2x" srcset="a.jpg 1x, b.jpg 2x"/>'),
    ("lazy: loaded", '<img src="a.jpg" data-src="b.jpg">', '<img src="a.jpg" data-src="b.jpg"/>'),
    ("links: relative", '<a href="other.html">a</a><img src="/i.png">', '<a href="https://a.example/dir/other.html">a</a><img src="https://a.example/i.png"/>'),
    ("links: fragment", '<a href="#part">a</a>', '<a href="#part">a</a>'),
    ("links: script", '<a href="javascript:go()">a</a><a href="javascript:go()"><b>c</b></a>', "a<span><b>c</b></span>"),
    ("links: set", '<img srcset="a.png 1x, b.png 2x">', '<img srcset="https://a.example/dir/a.png 1x, https://a.example/dir/b.png 2x"/>'),
    ("nested: only child", '<div class="a"><div id="b">x</div></div>', '<div class="a" id="b">x</div>'),
    ("nested: empty", "<div></div><section> </section><p>a</p>", "<p>a</p>"),
    ("nested: text beside", "<div>t<div>x</div></div>", "<div>t<div>x</div></div>"),
    ("classes: kept", '<p class="page x">a</p><p class="y">b</p>', '<p class="page">a</p><p>b</p>'),
    ("headers: repeated", "<h1>Example Domain</h1><h1>Example Domain</h1><p>a</p>", "<h1>Example Domain</h1><p>a</p>"),
    ("headers: title once", "<h1>A long title of the page</h1><h2>A long title of the page here</h2><h2>Part</h2>", "<h1>A long title of the page</h1><h2>Part</h2>"),
    ("headers: empty", "<h2> </h2><p>a</p>", "<h2> </h2><p>a</p>"),
    ("clean: footer, aside, nav", f"<p>{_LONG}</p><footer>f</footer><aside>s</aside><nav>n</nav>", f"<p>{_LONG}</p>"),
    ("clean: embedded", f'<p>{_LONG}</p><iframe src="https://x.example"></iframe><iframe src="https://www.youtube.com/embed/1"></iframe>', f'<p>{_LONG}</p><iframe src="https://www.youtube.com/embed/1"></iframe>'),
    ("clean: fields", f"<p>{_LONG}</p><input><textarea></textarea><select></select><button>b</button>", f"<p>{_LONG}</p>"),
    ("clean: share", f'<p>{_LONG}</p><div class="share">Share it</div>', f"<p>{_LONG}</p>"),
    ("clean: empty paragraph", f"<p>{_LONG}</p><p> </p>", f"<p>{_LONG}</p>"),
    ("clean: list of links stays", f'<p>{_LONG}</p><ul><li><a href="/a">one</a></li></ul>', f'<p>{_LONG}</p><ul><li><a href="/a">one</a></li></ul>'),
    ("clean: links in a div", f'<p>{_LONG}</p><div><a href="/a">one of the links</a></div>', f"<p>{_LONG}</p>"),
    ("clean: list with content", f'<p>{_LONG}</p><ul><li>one thing and <a href="/a">a</a></li></ul>', f'<p>{_LONG}</p><ul><li>one thing and <a href="/a">a</a></li></ul>'),
    ("clean: one cell", f"<p>{_LONG}</p><table><tr><td><b>x</b> y</td></tr></table>", f"<p>{_LONG}</p><p><b>x</b> y</p>"),
    ("clean: break before a paragraph", f"<div>a<br><p>{_LONG}</p></div>", f"<div>a<p>{_LONG}</p></div>"),
    ("headings: levels", "<h1>a</h1><h3>b</h3><h3>c</h3><h6>d</h6>", "<h1>a</h1><h2>b</h2><h3>c</h3><h4>d</h4>"),
    ("lists: orphans", "<div><li>a</li><li>b</li></div>", "<div><ul><li>a</li><li>b</li></ul></div>"),
    ("optimise: attributes", '<p onclick="x" data-a="1" data-src="s" id="i">a</p><!-- c -->', '<p data-src="s" id="i">a</p>'),
    ("load: images", '<img src="a.png">', '<img src="a.png" loading="lazy"/>'),
    ("repair: all", "<p>a</p>", "<html><head></head><body><p>a</p></body></html>"),
    ("repair: body", "<body><p>a</p></body>", "<html><head></head><body><p>a</p></body></html>"),
    ("fallback: short", "<p>a b</p>", "a b"),
    ("listed: blocks", "<p>one</p><ul><li>a</li><li>b</li></ul><p>two</p>", "one / * a, * b,  / two"),
    ("main: article", f"<article><p>{_LONG}</p></article><main>x</main>", "article"),
    ("main: body", "<p>short</p>", "body"),
]
_mapped("step_cases", "string", "VARCHAR", STEP_CASES, lambda n, i: STEPS[n.split(":")[0]](i))

# Simplification: the part of the name before the colon names the steps that run -------------------------------------------
SIMPLIFY = [
    ("normalize: whitespace", "<body><p>Hello   World</p><p>Multiple    Spaces</p></body>", "<div><p>Hello World</p><p>Multiple Spaces</p></div>"),
    ("remove_blacklist: script and button", "<body><p>Text</p><script>alert('hello');</script><button>Click me</button></body>", "<div><p>Text</p></div>"),
    ("remove_blacklist: details and dialog", "<body><p>Text</p><details><summary>s</summary>d</details><dialog>x</dialog><data>y</data></body>", "<div><p>Text</p></div>"),
    ("remove_blacklist: figure stays", "<body><figure><figcaption>cap</figcaption></figure></body>", "<div><figure><figcaption>cap</figcaption></figure></div>"),
    ("remove_blacklist: chrome", '<body><p>Text</p><header>h</header><div class="main-menu">m</div><p id="footer2">f</p><div class="ad">a</div></body>', "<div><p>Text</p></div>"),
    ("remove_blacklist: links", '<body><p>Text</p><div><a href="x">all of it</a></div></body>', "<div><p>Text</p></div>"),
    ("unwrap: inline", "<body><p><span>Hello</span> <b>World</b></p></body>", "<div><p>Hello World</p></div>"),
    ("unwrap: link", '<body><p>see <a href="x">this</a></p></body>', "<div><p>see this</p></div>"),
    ("signs: special elements", "<body><p><q>Quote</q> and <sub>subscript</sub> and <sup>superscript</sup></p></body>", '<div><p>"Quote" and _subscript and ^superscript</p></div>'),
    ("unknown: elements", "<body><p><foo>a</foo> b</p></body>", "<div><p>a b</p></div>"),
    ("remove_empty: elements", "<html><head></head><body><p>Text</p><p></p><div>  </div></body></html>", "<div><p>Text</p></div>"),
    ("break_paragraphs consolidate: breaks", "<body><p>First<br><br>Second</p></body>", "<div><p>First</p><p>Second</p></div>"),
    ("wrap_text remove_empty normalize: bare text", "<body>Bare text <div>Inside div</div></body>", "<div><p>Bare text</p><div>Inside div</div></div>"),
    ("remove_metadata: comment", "<body><p>a<!-- c --></p></body>", "<div><p>a</p></div>"),
    ("strip_attributes: class and style", '<body><p class="c" style="s" id="i">a</p></body>', '<div><p id="i">a</p></div>'),
    ("indexes: nodes", "<body><p>Hello</p><div><p>World</p></div></body>", '<div data-node-index="0"><p data-node-index="0.1">Hello</p><div data-node-index="0.2"><p data-node-index="0.2.1">World</p></div></div>'),
]


def _steps(name: str) -> S.Steps:
    on = set(name.split(":")[0].split(" "))
    return S.Steps(**{f: f in on for f in S.Steps.__dataclass_fields__})


_mapped("simplify_cases", "string", "VARCHAR", SIMPLIFY, lambda n, i: S.simplify(i, _steps(n)))

DIGESTS = [
    ("p", "<p>Hello</p>", "185f8db32271fe25f561a6fc938b2e264306ec304eda518007d1764826381969"),
    ("p again", "<p>World</p>", "78ae647dc5544d227130a0682a51e30bc7777fbb6d8a8f17007463a3ecd1d524"),
    ("div", "<div><p>Hello</p><p>World</p></div>", hashlib.sha256(b"185f8db32271fe25f561a6fc938b2e264306ec304eda518007d176482638196978ae647dc5544d227130a0682a51e30bc7777fbb6d8a8f17007463a3ecd1d524").hexdigest()),
    ("empty p", "<p></p>", ""),
]
_mapped("digest_cases", "string", "VARCHAR", DIGESTS, lambda n, i: X.node_digest(_first(i, n.split(" ")[-1] if n.startswith("empty") else n.split(" ")[0])))

# Predicates and measures ----------------------------------------------------------------------------------------------
PREDICATES: dict[str, Callable[[Node], bool]] = {
    "visible": M.visible, "unlikely": M.is_unlikely, "block child": M.has_block_child, "phrasing": M.is_phrasing, "empty": M.without_content,
    "single p": lambda n: M.single_child(n, "p") is not None, "single image": M.single_image, "video": M.is_allowed_video, "layout": M.is_layout_table,
    "data": M.is_data_table, "navigation": M.is_nav_table, "list content": M.list_has_content, "image": S.is_relevant_image,
    "in table": lambda n: n.has_ancestor("table"), "in near div": lambda n: n.has_ancestor("div", 3),
}
#: The element that is asked about is the one whose id is x.
PREDICATE_CASES = [
    ("visible: plain", '<p id="x">a</p>', True), ("visible: display", '<p id="x" style="color:red;display:none">a</p>', False), ("visible: display with a blank", '<p id="x" style="display: none">a</p>', True), ("visible: hidden", '<p id="x" hidden>a</p>', False),
    ("visible: visibility", '<p id="x" style="visibility:hidden">a</p>', True), ("visible: aria", '<p id="x" aria-hidden="true">a</p>', False),
    ("visible: aria on an image kept", '<p id="x" aria-hidden="true" class="fallback-image">a</p>', True),
    ("unlikely: banner", '<div id="x" class="banner">a</div>', True), ("unlikely: maybe", '<div id="x" class="banner main">a</div>', False), ("unlikely: plain", '<div id="x">a</div>', False),
    ("block child: table", '<div id="x"><span><table></table></span></div>', True), ("block child: inline", '<div id="x"><span>a</span></div>', False),
    ("phrasing: span", '<span id="x">a</span>', True), ("phrasing: link", '<a id="x"><b>a</b></a>', True), ("phrasing: link with a block", '<a id="x"><div>a</div></a>', False), ("phrasing: div", '<div id="x">a</div>', False),
    ("empty: breaks", '<div id="x"><br><hr></div>', True), ("empty: text", '<div id="x">a</div>', False), ("empty: image", '<div id="x"><img src="a"></div>', False),
    ("single p: alone", '<div id="x"> <p>a</p> </div>', True), ("single p: text", '<div id="x">t<p>a</p></div>', False), ("single p: two", '<div id="x"><p>a</p><p>b</p></div>', False),
    ("single image: nested", '<div id="x"><span><img src="a"></span></div>', True), ("single image: text", '<div id="x">t<img src="a"></div>', False),
    ("video: allowed", '<iframe id="x" src="https://player.vimeo.com/video/1"></iframe>', True), ("video: other", '<iframe id="x" src="https://v.example/1"></iframe>', False),
    ("video: object", '<object id="x"><param value="https://www.youtube.com/v/1"></object>', True),
    ("layout: presentation", '<table id="x" role="presentation"><tr><td>a</td></tr></table>', True), ("layout: plain", '<table id="x"><tr><td>a</td></tr></table>', False),
    ("data: summary", '<table id="x" summary="s"><tr><td>a</td></tr></table>', True), ("data: caption", '<table id="x"><caption>c</caption><tr><td>a</td></tr></table>', True),
    ("data: head", '<table id="x"><tr><th>a</th></tr></table>', True), ("data: plain", '<table id="x"><tr><td>a</td></tr></table>', False),
    ("navigation: links", '<table id="x"><tr><td><a href="/1">one</a></td><td><a href="/2">two</a></td></tr></table>', True), ("navigation: text", '<table id="x"><tr><td>one</td></tr></table>', False),
    ("list content: text", '<ul id="x"><li>one thing</li></ul>', True), ("list content: links", '<ul id="x"><li><a href="/">one</a></li></ul>', False), ("list content: none", '<ul id="x"></ul>', False),
    ("list content: notes aren't links", '<ul id="x"><li><a data-type="noteref" href="/">one</a></li></ul>', True),
    ("image: alternative text", '<img id="x" src="image.jpg" alt="A relevant image">', True), ("image: small", '<img id="x" src="pic.png" width="16" height="16">', False),
    ("image: logo", '<img id="x" src="logo.png" alt="">', False), ("image: caption", '<figure><img id="x" src="image.jpg"><figcaption>Image caption</figcaption></figure>', True),
    ("image: background", '<img id="x" src="bg.jpg" style="background-image: url(p.jpg)">', False), ("image: content area", '<div class="content"><img id="x" src="content-image.jpg"></div>', True),
    ("image: tracking", '<img id="x" src="tracking.gif" alt="A view of it">', False), ("image: one pixel", '<img id="x" src="1x1.gif">', False),
    ("image: arrow with text", '<img id="x" src="arrow-river.jpg" alt="The river at night">', True), ("image: generic text", '<img id="x" src="p.jpg" alt="Thumbnail" role="presentation">', False),
    ("image: short text", '<img id="x" src="p.jpg" alt="Map" role="presentation">', True), ("image: no rule", '<img id="x" src="p.jpg">', True), ("image: background in a post", '<div class="post"><img id="x" src="p.jpg" class="bg"></div>', True),
    ("in table: cell", '<table><tr><td><b id="x">a</b></td></tr></table>', True), ("in table: no", '<p id="x">a</p>', False),
    ("in near div: four up", '<div><p><b><i><u id="x">a</u></i></b></p></div>', True), ("in near div: five up", '<div><p><b><i><u><s id="x">a</s></u></i></b></p></div>', False),
]
_mapped("predicate_cases", "boolean", "BOOLEAN", PREDICATE_CASES, lambda n, i: bool(PREDICATES[n.split(":")[0]](next(e for e in parse(i).walk() if e.get("id") == "x"))))

MEASURES: dict[str, Callable[[Node], float]] = {
    "links": M.link_density, "table links": M.table_link_density, "class weight": M.class_weight, "rows": lambda n: M.table_shape(n)[0], "columns": lambda n: M.table_shape(n)[1],
    "cells": lambda n: M.table_shape(n)[2], "p share": lambda n: MD.text_density(n, "p"), "share of nothing": lambda n: MD.text_density(n), "bytes": lambda n: M.nbytes(n.text()),
    "commas": lambda n: n.text().count(","), "items": lambda n: len(n.find_all("li")),
}
MEASURE_CASES = [
    ("links: half", '<p id="x">abcde<a href="/">fghij</a></p>', 0.5), ("links: fragment counts three tenths", '<p id="x"><a href="#part">abcdefghij</a></p>', 0.3), ("links: none", '<p id="x">abc</p>', 0.0),
    ("links: empty", '<p id="x"></p>', 0.0), ("links: notes don't count", '<p id="x">abcde<a data-type="noteref" href="/">fghij</a></p>', 0.0), ("table links: all", '<table id="x"><tr><td><a href="#a">abc</a></td></tr></table>', 1.0),
    ("class weight: good and bad", '<p id="x" class="article sidebar">a</p>', 0.0), ("class weight: good", '<p id="x" class="article">a</p>', 25.0), ("class weight: bad", '<p id="x" class="promo">a</p>', -25.0),
    ("rows: two", '<table id="x"><tr><td>a</td></tr><tr><td>b</td></tr></table>', 2.0), ("columns: span", '<table id="x"><tr><td colspan="3">a</td><td>b</td></tr></table>', 4.0), ("cells: three", '<table id="x"><tr><td>a</td><th>b</th></tr><tr><td>c</td></tr></table>', 3.0),
    ("p share: half", '<div id="x"><p>abcd</p><span>efg</span></div>', 0.5), ("share of nothing: zero", '<div id="x"><p>a</p></div>', 0.0), ("bytes: not letters", '<p id="x">äb</p>', 3.0), ("bytes: blanks", '<p id="x">  a \n b </p>', 3.0),
    ("commas: ten", '<p id="x">This text has 10 commas, one here, two here, three here, four here, five here, six here, seven here, eight here, nine here, and ten here.</p>', 10.0),
    ("items: two", '<article id="x"><ul><li>List item 1</li><li>List item 2</li></ul></article>', 2.0),
]
_mapped("measure_cases", "double", "DOUBLE", MEASURE_CASES, lambda n, i: round(float(MEASURES[n.split(":")[0]](next(e for e in parse(i).walk() if e.get("id") == "x"))), 9))

# Metadata, titles, dates, bylines -----------------------------------------------------------------------------------------
_DATED = '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "NewsArticle", "headline": "JSON-LD Headline", "author": {"@type": "Person", "name": "Jane Smith"}, "datePublished": "2025-03-27"}</script>'
META_CASES = [
    ("all: linked data first", f'<title>Article Title</title><meta name="author" content="John Doe"><meta property="og:title" content="OpenGraph Title"><meta property="og:description" content="OpenGraph description"><meta name="description" content="Meta description">{_DATED}',
     '{"byline": "Jane Smith", "date": "2025-03-27", "excerpt": "OpenGraph description", "site_name": "", "title": "Article Title"}'),
    ("all: metas", '<meta name="dc.title" content="T &amp;amp; U"><meta name="author" content="A B"><meta property="og:site_name" content="S">', '{"byline": "A B", "date": "", "excerpt": "", "site_name": "S", "title": "T & U"}'),
    ("linked: names", _DATED, '{"byline": "Jane Smith", "date": "2025-03-27", "title": "JSON-LD Headline"}'),
    ("linked: other type", _DATED.replace("NewsArticle", "Organization"), "{}"),
    ("field: title", '<meta property="og:title" content=" T ">', '"T"'), ("field: author", '<meta name="byline" content="B"><meta name="author" content="A">', '"A"'), ("field: none", "<p>x</p>", '""'),
    ("root: title", "<title> A </title>", '"A"'), ("root: base", '<base href="https://a.example/some-page_one.html">', '"Some Page One"'),
    ("adjacent: after", '<p id="x">a</p><p class="byline">Ann Lee</p>', '"Ann Lee"'), ("adjacent: none", '<p id="x">a</p><p>Ann Lee</p>', '""'),
]
META: dict[str, Callable[[str, Node], object]] = {
    "all": lambda n, r: X.metadata(r), "linked": lambda n, r: X.json_ld(r), "root": lambda n, r: MD.root_title(r), "field": lambda n, r: MD.meta_field(r, {"none": "title"}.get(n, n)),
    "adjacent": lambda n, r: MD.adjacent_byline(next(e for e in r.walk() if e.get("id") == "x")),
}
_mapped("metadata_cases", "string", "VARCHAR", META_CASES, lambda n, i: json.dumps(META[n.split(":")[0]](n.split(": ")[1], parse(i)), sort_keys=True))

TITLES = [
    ("headline", '<title>x</title><h1 itemprop="headline">A headline of the page itself</h1>', "A headline of the page itself"),
    ("site behind a bar", "<title>A fine story about rivers | The Site</title>", "A fine story about rivers"),
    ("site before a bar", "<title>News | A fine story about old rivers</title>", "A fine story about old rivers"),
    ("colon", "<title>The Site: A fine story about old rivers</title>", "A fine story about old rivers"),
    ("colon in the heading", "<title>Rivers: a fine story of the land</title><h1>Rivers: a fine story of the land</h1>", "Rivers: a fine story of the land"),
    ("short, one heading", "<title>Page</title><h1>A heading that tells more of it</h1>", "A heading that tells more of it"),
    ("short, no heading", "<title>Test Page</title>", "Test Page"),
    ("none", "<p>x</p>", None),
]
_columns("title_cases", "name VARCHAR, value VARCHAR", TITLES, [(n, v) for n, _, v in TITLES], lambda df: df.select("name", page_title_column("input").alias("value")))

DATES = [
    ("meta beats visible, time kept", '<meta property="article:published_time" content="2023-03-27T15:04:05Z"><span class="date">March 1, 2020</span>', "2023-03-27 15:04:05"),
    ("visible", '<span class="date">March 27, 2023</span>', "2023-03-27 00:00:00"),
    ("time element", '<time datetime="2023-03-27T10:00:00+02:00">x</time>', "2023-03-27 08:00:00"),
    ("a time of day wins", '<meta name="date" content="2021-01-01"><span class="published">2020-05-05T01:02:03Z</span>', "2020-05-05 01:02:03"),
    ("none", "<p>no date</p>", None),
]
_columns("date_page_cases", "name VARCHAR, value TIMESTAMP", DATES, [(n, v) for n, _, v in DATES], lambda df: df.select("name", page_date_column("input").cast("timestamp_ntz").alias("value")))

BYLINES = [
    ("meta", '<meta name="byl" content="By Charlie Brown">', "Charlie Brown"), ("paragraph", "<p>Written by Michael Lee</p>", "Michael Lee"), ("suffix", '<meta name="author" content="Ann Lee | Writer">', "Ann Lee"),
    ("meta beats span", '<meta name="author" content="A Meta"><span class="author">A Span</span>', "A Meta"), ("link", '<a rel="author">Ann Lee</a>', "Ann Lee"),
    ("in an article's own words", '<div itemscope itemtype="http://schema.org/Article"><span itemprop="author">Ann Lee</span></div>', "Ann Lee"), ("none", "<p>x</p>", ""),
]
_columns("byline_page_cases", "name VARCHAR, value VARCHAR", BYLINES, [(n, v) for n, _, v in BYLINES], lambda df: df.select("name", page_byline_column("input").alias("value")))

ISO = [
    ("zone", "2023-03-27T15:04:05+02:00", "2023-03-27 13:04:05"), ("fraction", "2023-03-27T15:04:05.123Z", "2023-03-27 15:04:05"), ("fraction without zone", "2014-10-24T17:32:46.493", "2014-10-24 17:32:46"),
    ("no zone", "2014-10-24T17:32:46", "2014-10-24 17:32:46"), ("zone without colon", "2014-10-24T17:32:46-0700", "2014-10-25 00:32:46"), ("day", "2014-10-24", "2014-10-24 00:00:00"), ("day and Z", "2014-10-24Z", "2014-10-24 00:00:00"),
    ("compact", "20141024T173246Z", "2014-10-24 17:32:46"), ("mail", "Mon, 27 Mar 2023 15:04:05 GMT", "2023-03-27 15:04:05"), ("mail with offset", "Mon, 27 Mar 2023 15:04:05 +0100", "2023-03-27 14:04:05"),
    ("short mail", "27 Mar 23 15:04 UTC", "2023-03-27 15:04:00"), ("short mail with offset", "27 Mar 23 15:04 +0200", "2023-03-27 13:04:00"), ("long day", "Monday, 27-Mar-23 15:04:05 GMT", "2023-03-27 15:04:05"),
    ("last century", "02 Jan 69 15:04 UTC", "1969-01-02 15:04:00"), ("not a date", "not a date", None),
]


def _iso(df: DataFrame) -> DataFrame:
    from pagewright.functions.dates import parse_iso

    return df.select("name", parse_iso("input").cast("timestamp_ntz").alias("value"))


_columns("iso_cases", "name VARCHAR, value TIMESTAMP", ISO, [(n, v) for n, _, v in ISO], _iso)

# Texts ------------------------------------------------------------------------------------------------------------------
ENTITY_CASES = [
    ("named", "&copy; 2020 &ndash; a&nbsp;b", "© 2020 – a\u00a0b"), ("basic", "&lt;b&gt; &amp; &quot;x&quot;", '<b> & "x"'), ("once", "&amp;lt;", "&lt;"), ("unknown", "&nosuch; &", "&nosuch; &"), ("none", "plain", "plain"),
]
_columns("entity_cases", "name VARCHAR, value VARCHAR", ENTITY_CASES, [(n, v) for n, _, v in ENTITY_CASES], lambda df: df.select("name", T.decode_entities("input").alias("value")))
BASIC = [("five", "&lt;b&gt; &amp; &quot;&apos;", "<b> & \"'"), ("others stay", "&copy; &lt;", "&copy; <"), ("amp last", "&amp;lt;", "&lt;")]
_columns("basic_entity_cases", "name VARCHAR, value VARCHAR", BASIC, [(n, v) for n, _, v in BASIC], lambda df: df.select("name", T.unescape_basic("input").alias("value")))
UNICODE = [
    ("composed", "é", "é"), ("blank", "hello world", "hello world"), ("quotes", "“a” ‘b’", "\"a\" 'b'"), ("dashes", "a–b—c", "a-b--c"), ("signs", "© 5×3", "(C) 5x3"), ("width", "ＡＢ", "AB"),
]
_columns("unicode_cases", "name VARCHAR, value VARCHAR", UNICODE, [(n, v) for n, _, v in UNICODE], lambda df: df.select("name", T.normalize_unicode("input").alias("value")))
TEXTS = [
    ("combined", "\x00Hello\x01 \x02World\x03\n ", "Hello World"), ("blanks", "hello  world ", "hello world"), ("unicode", "é  x", "é x"),
]
_columns("normalize_cases", "name VARCHAR, value VARCHAR", TEXTS, [(n, v) for n, _, v in TEXTS], lambda df: df.select("name", T.normalize_text("input").alias("value")))
WEIGHTS = [("content", "article-body", True, False), ("navigation", "nav", False, True), ("both", "content sidebar", True, True), ("neither", "x", False, False)]


def _words(df: DataFrame) -> DataFrame:
    from pagewright.functions import rules

    return df.select("name", T.has_word("input", rules.CONTENT_WORDS).alias("content"), T.has_word("input", rules.NON_CONTENT_WORDS).alias("other"))


_columns("pattern_cases", "name VARCHAR, content BOOLEAN, other BOOLEAN", WEIGHTS, [(n, c, o) for n, _, c, o in WEIGHTS], _words)
CATEGORIES = [("Cc", "\x01", True), ("Cf", "؜", True), ("Co", "", True), ("letter", "a", False), ("digit", "7", False)]
_columns("category_cases", "name VARCHAR, value BOOLEAN", CATEGORIES, [(n, v) for n, _, v in CATEGORIES], lambda df: df.select("name", T.is_control_category("input").alias("value")))

# Relations over nodes -----------------------------------------------------------------------------------------------------
def _nodes(df: DataFrame) -> DataFrame:
    return N.dom_nodes(df, "input", "name")


_S = "a" * 49 + "."  # 50 bytes
SCORED = [
    # each p scores 1 + commas + bytes / 100; its parent takes it whole, the next a half, the third a sixth
    ("one", f'<section><article class="story"><p>{_S}</p><p>{_S[:48]},{_S[:1]}</p></article></section>'),
]
# section and body count as elements too: the section's own text of 101 bytes scores 1 + 1 + 1.01 for the body
SCORES = [
    ("one", "article", 1.5 + 2.5 + 25), ("one", "section", 1.5 / 2 + 2.5 / 2), ("one", "body", 1.5 / 6 + 2.5 / 6 + 3.01),
]
_columns("score_cases", "name VARCHAR, tag VARCHAR, score DOUBLE", SCORED, [(n, t, round(s, 6)) for n, t, s in SCORES],
         lambda df: N.candidate_scores(_nodes(df), "name").select("name", "tag", F.round("score", 6).alias("score")))
_columns("top_cases", "name VARCHAR, tag VARCHAR, rank INTEGER", SCORED, [("one", "article", 1), ("one", "body", 2), ("one", "section", 3)],
         lambda df: N.top_candidates(N.candidate_scores(_nodes(df), "name"), "name", 3).select("name", "tag", "rank"))


def _siblings(df: DataFrame) -> DataFrame:
    nodes = _nodes(df)
    named = nodes.select("name", "node_id", F.try_element_at("attrs", F.lit("id")).alias("id"))
    return N.siblings_of_top(nodes, N.candidate_scores(nodes, "name"), "name").join(named, ["name", "node_id"]).select("name", "id", "is_top")


_COMMAS = "one, two, three, four, five, six, seven, eight, nine, ten, eleven, twelve, and so on to the end."
SIBLINGS = [
    ("paragraphs", f'<div id="a" class="article"><p>{_COMMAS}</p><p>{_COMMAS}</p><p>{_COMMAS}</p></div><p id="b">Short line. End.</p><p id="c">No end</p><p id="d"><a href="/">Linked line. End.</a></p><p id="e">{_LONG}</p><h2 id="f">Heading</h2>'),
]
_columns("sibling_cases", "name VARCHAR, id VARCHAR, is_top BOOLEAN", SIBLINGS, [("paragraphs", "a", True), ("paragraphs", "b", False), ("paragraphs", "e", False)], _siblings)

HEADED = [("levels", "<h1>a</h1><h3>b</h3><h3>c</h3><h6>d</h6><h2>a</h2>")]
_columns("heading_cases", "name VARCHAR, level INTEGER, kept_level INTEGER, text VARCHAR, first BOOLEAN", HEADED,
         [("levels", 1, 1, "a", True), ("levels", 3, 2, "b", True), ("levels", 3, 3, "c", True), ("levels", 6, 4, "d", True), ("levels", 2, 2, "a", False)],
         lambda df: N.headings(_nodes(df), "name").select("name", "level", "kept_level", "text", "first"))

BLOCKS = [("kinds", "<p>one</p><h2>two</h2><ol><li>three</li></ol><blockquote>four</blockquote><ul><li>five</li></ul><p> </p><h1>six</h1>")]
_columns("block_cases", "name VARCHAR, kind VARCHAR, level INTEGER, place INTEGER, text VARCHAR, list_type VARCHAR", BLOCKS,
         [("kinds", "paragraph", 0, 0, "one", None), ("kinds", "heading", 1, 1, "six", None), ("kinds", "heading", 2, 2, "two", None), ("kinds", "list-item", 0, 3, "three", "ordered"), ("kinds", "list-item", 0, 4, "five", "unordered"), ("kinds", "blockquote", 0, 5, "four", None)],
         lambda df: N.typed_blocks(_nodes(df), "name").select("name", "kind", "level", "place", "text", F.try_element_at("metadata", F.lit("list-type")).alias("list_type")))

LINKED = [("links", '<a href="/a">Read more</a><a href="/b">Ann</a><a href="/a">again</a>')]
_columns("link_cases", "name VARCHAR, href VARCHAR, text VARCHAR, important BOOLEAN", LINKED, [("links", "/a", "Read more", True), ("links", "/b", "Ann", False)],
         lambda df: N.links(_nodes(df), "name").select("name", "href", "text", "important"))

INDEXED = [("nested", "<p>Hello</p><div><p>World</p><ul><li>a</li><li>b</li></ul></div>")]
_columns("index_cases", "name VARCHAR, tag VARCHAR, node_index VARCHAR", INDEXED,
         [("nested", "body", "0"), ("nested", "p", "0.1"), ("nested", "div", "0.2"), ("nested", "p", "0.2.1"), ("nested", "ul", "0.2.2"), ("nested", "li", "0.2.2.1"), ("nested", "li", "0.2.2.2")],
         lambda df: (lambda nodes: N.node_indexes(nodes, "name").join(nodes.select("name", "node_id", "tag"), ["name", "node_id"]).select("name", "tag", "node_index"))(_nodes(df)))

_ROW = "<tr><td>a</td><td>b</td></tr>"
TABLED = [
    ("head", "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", 2, 2, 4, 0, "data"),
    ("presentation", f'<table role="presentation">{_ROW}</table>', 1, 2, 2, 0, "layout"),
    ("links", '<table><tr><td><a href="/1">one</a></td><td><a href="/2">two</a></td></tr></table>', 1, 2, 2, 0, "nav"),
    ("even", f"<table>{_ROW}{_ROW}</table>", 2, 2, 4, 0, "data"),
    ("small", "<table><tr><td>a</td></tr></table>", 1, 1, 1, 0, "layout"),
    ("span", '<table><tr><td colspan="3">a</td></tr><tr><td>b</td></tr></table>', 2, 3, 2, 0, "data"),
    ("named", f'<table class="results"><tr><td>a</td></tr></table>', 1, 1, 1, 0, "data"),
]
_columns("table_cases", "name VARCHAR, rows INTEGER, columns INTEGER, cells INTEGER, nesting INTEGER, kind VARCHAR", TABLED, [(n, r, c, k, d, t) for n, _, r, c, k, d, t in TABLED],
         lambda df: N.tables(_nodes(df), "name").drop("node_id"))

PICTURED = [
    ("text", '<img src="image.jpg" alt="A relevant image">', "A relevant image", True), ("small", '<img src="pic.png" width="16" height="16">', None, False), ("logo", '<img src="logo.png" alt="">', None, False),
    ("caption", '<figure><img src="image.jpg" alt="Alt text"><figcaption>Figure caption</figcaption></figure>', "Figure caption", True), ("title", '<img src="image.jpg" title="Image title">', "Image title", True),
    ("background", '<img src="bg.jpg" style="background-image: url(p.jpg)">', None, False), ("area", '<div class="content"><img src="content-image.jpg" class="bg"></div>', None, True), ("pixel", '<img src="1px.gif" alt="A view">', "A view", False),
]
_columns("image_cases", "name VARCHAR, caption VARCHAR, relevant BOOLEAN", PICTURED, [(n, c, r) for n, _, c, r in PICTURED], lambda df: N.images(_nodes(df), "name").select("name", "caption", "relevant"))

CHOSEN = [
    ("content", '<header><h1>Website Title</h1><nav><ul><li><a href="#">Home</a></li><li><a href="#">About</a></li></ul></nav></header><main id="content"><article><h1>Main Article Heading</h1><p>This is a paragraph with some text.</p>'
     '<p>This is another paragraph with more text for testing.</p><h2>This is a subheading</h2><p>More content here.</p><ul><li>List item 1</li><li>List item 2</li></ul></article></main>'
     '<aside id="sidebar"><h3>Sidebar</h3><p>This is a sidebar.</p><ul><li><a href="#">Link 1</a></li><li><a href="#">Link 2</a></li></ul></aside><footer><p>Copyright 2025</p></footer>', True),
]
_columns("main_cases", "name VARCHAR, value BOOLEAN", CHOSEN, [(n, v) for n, _, v in CHOSEN], lambda df: N.main_content(_nodes(df), "name").select("name", F.col("tag").isin("article", "main").alias("value")))

FAMILY = [("one", "<div><h2>abcd</h2><ul><li>efgh</li></ul></div>")]
# the div's text is "abcd efgh", 9 bytes; its markup has 46
_columns("density_cases", "name VARCHAR, text_to_code DOUBLE, link_score DOUBLE, heading_density DOUBLE, list_density DOUBLE, image_density DOUBLE", FAMILY,
         [("one", round(9 / 46, 6), 1.0, round(1000 / 9, 6), round(1000 / 9, 6), 0.0)],
         lambda df: _nodes(df).where("tag = 'div'").select("name", *[F.round(c, 6).alias(k) for k, c in N.density_measures().items() if k != "content_density"]))

SELECTED = [("page", '<meta name="x"><span class="date top">May 1</span><time datetime="2020-01-01">May 1</time><p class="date">May 2</p>')]


def _selected(df: DataFrame) -> DataFrame:
    rows = [("span.date", "span", "class", "date", "text", 3), ("time", "time", None, None, "text", 2), ("any.date", None, "class", "date", "text", 1), ("time at", "time", None, None, "datetime", 4)]
    selectors = df.sparkSession.createDataFrame(rows, "selector string, tag string, attribute string, word string, value_of string, score int")
    found = N.selector_scores(_nodes(df), selectors, "name")
    return found.select("name", "value", F.col("score").cast("int").alias("score"), F.array_join("selectors", ",").alias("selectors"))


_columns("selector_cases", "name VARCHAR, value VARCHAR, score INTEGER, selectors VARCHAR", SELECTED,
         [("page", "May 1", 6, "any.date,span.date,time"), ("page", "2020-01-01", 4, "time at"), ("page", "May 2", 1, "any.date")], _selected)

# Whole extractions --------------------------------------------------------------------------------------------------------
_NAV = """<!DOCTYPE html><html><head><title>Test Page</title></head><body><nav class="navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav>
<main><h1>Main Content</h1><p>This is the main content of the page.</p><a href="https://example.com/important-link">Important Link</a></main><footer class="footer"><p>Copyright 2025</p></footer></body></html>"""
_FOOT = """<html><head><title>Simple Test Page</title></head><body><article><h1>Main Content</h1><p>This is the main content.</p></article><footer>Test Footer <a href="https://example.com/more">More information...</a></footer></body></html>"""
_MORE = "Read more|More info|See more|View more|Read full|Continue reading|...|More|Click for more|See also".split("|")
_MANY = "<html><head><title>Links</title></head><body><article><h1>Main Content</h1><p>This is the main content.</p><footer><div>" + " ".join(f'<a href="https://example.com/more-{i}">{t}</a>' for i, t in enumerate(_MORE)) + "</div></footer></article></body></html>"
_TWICE = "<html><head><title>Example Domain</title></head><body><div><h1>Example Domain</h1><h1>Example Domain</h1><p>This domain is for use in illustrative examples in documents.</p></div></body></html>"
_DEEP = "<html><body>" + "<div>" * 40 + f"<h1>Deep</h1><p>{_LONG}</p>" + "</div>" * 40 + "</body></html>"
#: (name, page, what its content must or must not hold)
HELD = [
    ("navigation", _NAV, "Main Content|This is the main content of the page.|Important Link", "<nav|About|Copyright"),
    ("footer", _FOOT, "Main Content", "Test Footer"),
    ("links kept", _FOOT, "Main Content|More information...", ""),
    ("many links kept", _MANY, "|".join(_MORE), ""),
    ("headings", _TWICE, "Example Domain|illustrative", "Example Domain</h1><h1>"),
    ("deep", _DEEP, "Deep|long enough", ""),
]


def _extracted(df: DataFrame) -> DataFrame:
    pages = [X.extract_articles(df.where(F.col("name").contains("links") == kept), ExtractOptions(preserve_important_links=kept), "input", keep=("name",)) for kept in (False, True)]
    needles = df.sparkSession.createDataFrame([(n, x) for n, _, yes, no in HELD for x in f"{yes}|{no}".split("|") if x], "name string, needle string")
    return pages[0].unionByName(pages[1]).join(F.broadcast(needles), "name").select("name", "needle", F.contains("content", "needle").alias("held"))


_columns("extract_cases", "name VARCHAR, needle VARCHAR, held BOOLEAN", HELD, [(n, x, k) for n, _, yes, no in HELD for k, part in ((True, yes), (False, no)) for x in part.split("|") if x], _extracted)

RECORDS = [
    ("article", f'<html lang="en"><head><title>A fine story about rivers | The Site</title><meta name="author" content="Jane Doe"><meta property="og:site_name" content="The Site"></head><body><article><p>{_LONG * 4}</p></article></body></html>', "A fine story about rivers", "Jane Doe", "en", "The Site", True, 1),
    ("no page", None, None, None, None, None, False, 0),
    ("text only", "just text, no title", None, None, None, None, True, 1),
]


def _recorded(df: DataFrame) -> DataFrame:
    out = X.extract_articles(df, ExtractOptions(), "input", keep=("name",))
    return out.select("name", "title", "byline", "lang", "site_name", F.col("content").isNotNull().alias("has_content"), F.coalesce(F.size("plain_text"), F.lit(0)).alias("blocks"))


_columns("record_cases", "name VARCHAR, title VARCHAR, byline VARCHAR, lang VARCHAR, site_name VARCHAR, has_content BOOLEAN, blocks INTEGER", RECORDS, [(n, *r) for n, _, *r in RECORDS], _recorded)

_ARTICLE = "named_struct('title', 'T', 'byline', CAST(NULL AS string), 'date', CAST(NULL AS timestamp), 'content', '<p>a</p>', 'plain_content', '<div><p>a</p></div>', 'plain_text', array(named_struct('text', 'a'), named_struct('text', 'b')), 'content_type', 2)"
SINKS = [
    ("json", "json", '{"title":"T","content":"<p>a</p>","plain_content":"<div><p>a</p></div>","plain_text":[{"text":"a"},{"text":"b"}],"content_type":2}'),
    ("html", "html", "<p>a</p>"), ("text", "text", "a\n\nb\n\n"),
]


def _written(df: DataFrame) -> DataFrame:
    parts = [df.where(F.col("name") == f).select("name", F.expr(_ARTICLE).alias("a")).select("name", "a.*").select("name", output_column(f).alias("value")) for f in ("json", "html", "text")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_columns("sink_cases", "name VARCHAR, value VARCHAR", SINKS, [(n, v) for n, _, v in SINKS], _written)


def _table_function(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    X.register(spark)
    df.createOrReplaceTempView("pagewright_cases")
    return spark.sql("SELECT c.name, b.block_no, b.text FROM pagewright_cases c, LATERAL text_blocks(c.input) b")


BLOCKED = [("two", f"<article><p>First of them, {_LONG}</p><p>Second of them, {_LONG}</p></article>")]
_columns("udtf_cases", "name VARCHAR, block_no INTEGER, text VARCHAR", BLOCKED, [("two", 0, f"First of them, {_LONG}".strip()), ("two", 1, f"Second of them, {_LONG}".strip())], _table_function)



def _node_function(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    N.register(spark)
    df.createOrReplaceTempView("pagewright_node_cases")
    return spark.sql("SELECT c.name, n.node_id, n.parent_id, n.depth, n.tag, n.text FROM pagewright_node_cases c, LATERAL dom_nodes(c.input) n")


_columns("node_udtf_cases", "name VARCHAR, node_id INTEGER, parent_id INTEGER, depth INTEGER, tag VARCHAR, text VARCHAR", [("two", "<p>a <b>b</b></p>"), ("none", None)],
         [("two", 0, None, 0, "body", "a b"), ("two", 1, 0, 1, "p", "a b"), ("two", 2, 1, 2, "b", "b")], _node_function)

ERRORS = [("parse", "parse|extract|bad input|", "[parse:extract] bad input"), ("cause", "timeout|extract|too slow|after 30 s", "[timeout:extract] too slow: after 30 s"), ("validation", "validation|new|no page|", "[validation:new] no page")]


def _error(name: str, spec: str) -> str:
    from pagewright.errors import PageError, with_fallback, with_retry

    kind, function, message, cause = spec.split("|")
    tries: list[int] = []

    def step() -> str:
        tries.append(1)
        if len(tries) < 2:
            raise ValueError
        raise PageError(kind, function, message, ValueError(cause) if cause else None)

    try:
        return with_retry(step, 2, 0.0)
    except PageError as e:
        return with_fallback(lambda: 1 / 0, lambda: str(e))


_mapped("error_cases", "string", "VARCHAR", ERRORS, _error)
