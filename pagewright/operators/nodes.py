"""Pages as rows of nodes, and what is computed over them as relations: scores, the top candidate with its siblings, tables, links, headings and blocks.

Tree building is the only step in Python; everything after it is joins and aggregations on (page_id, node_id), which Spark distributes and spills.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from pagewright.functions import rules
from pagewright.functions import text as T
from pagewright.operators import measures as M
from pagewright.operators.dom import RAW, Node, body_of, escape, parse
from pagewright.operators.extract import prepare
from pagewright.schema import NODE

#: Tags whose numbers below each node are kept.
COUNTED = ("p", "img", "li", "input", "a", "h1", "h2", "h3", "h4", "h5", "h6", "object", "embed", "iframe", "tr", "td", "th", "table", "figure")


#: Name under which figures with an image and a caption are counted.
CAPTIONED = "captioned figure"
#: Nodes that are handed over together.
FRAME_ROWS = 5000
#: Selectors up to which the table of them is sent to every executor.
MOST_SELECTORS = 10_000


def page_nodes(source: str, prepared: bool = True) -> list[dict]:
    """The elements of a page's body in document order, with their measures."""
    root = parse(source)
    if prepared:
        prepare(root)
    out: list[dict] = []

    def add(n: Node, parent: int | None, path: list[int], tags: list[str], order: int) -> tuple[int, float, dict[str, int]]:
        """Adds a node and what is below; gives the bytes of its markup, those of its links' texts, and its counts."""
        node_id = len(out)
        row: dict = {}
        out.append(row)
        counts: dict[str, int] = {}
        links, size = 0.0, M.nbytes(Node(n.tag, n.attrs).outer_html()) + sum(M.nbytes(c if n.tag in RAW else escape(c)) for c in n.children if isinstance(c, str))
        captioned = n.tag == "figure" and n.find("figcaption") is not None and n.find("img") is not None
        for i, c in enumerate(n.elements()):
            inner, below, own = add(c, node_id, [*path, node_id], [*tags, n.tag], i)
            links += below
            size += inner
            for k, v in own.items():
                counts[k] = counts.get(k, 0) + v
            if c.tag in COUNTED:
                counts[c.tag] = counts.get(c.tag, 0) + 1
        text = n.text()
        own_links = links
        if n.tag == "a":
            own_links = 0.0 if n.get("data-type") in ("indexterm", "noteref") else float(int(M.nbytes(text) * (rules.HASH_LINK_SHARE if n.get("href").startswith("#") and len(n.get("href")) > 1 else 1.0)))
        row.update(
            node_id=node_id, parent_id=parent, path=path, path_tags=tags, depth=len(path), ord=order, tag=n.tag, attrs=dict(n.attrs),
            own_text="".join(c for c in n.children if isinstance(c, str)), text=text, text_bytes=M.nbytes(text), html_bytes=size,
            link_bytes=links, comma_count=text.count(","), tag_counts=counts, visible=M.visible(n),
        )
        if captioned:
            counts = {**counts, CAPTIONED: counts.get(CAPTIONED, 0) + 1}
        return size, own_links, counts

    add(body_of(root), None, [], [], 0)
    return out


def dom_nodes(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, node fields): one row for each element of each page's body. Pages without markup give no rows."""
    schema = StructType([pages.schema[key], *NODE.fields])

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=schema.fieldNames())
        out["parent_id"] = out["parent_id"].astype("Int32")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for pdf in batches:
            for k, source in zip(pdf[key], pdf[html]):
                if source:
                    rows += [{key: k, **r} for r in page_nodes(source)]
                if len(rows) >= FRAME_ROWS:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    return pages.select(key, html).mapInPandas(run, schema)


def link_density() -> Column:
    return F.when(F.col("text_bytes") == 0, 0.0).otherwise(F.col("link_bytes") / F.col("text_bytes"))


def candidate_scores(nodes: DataFrame, key: str = "page_id", weigh_classes: bool = True) -> DataFrame:
    """(key, node_id, tag, score, adjusted): each ancestor's sum of shares of the scored elements below, with its tag's and class's weights.
    The sum doesn't depend on the order of rows; no self-join, as each node holds its path."""
    own = nodes.where(F.col("tag").isin(*rules.TAGS_TO_SCORE) & (F.col("text_bytes") >= rules.MIN_SCORED_BYTES))
    score = 1 + F.col("comma_count") + F.least(F.col("text_bytes") / rules.LENGTH_DIVISOR, F.lit(rules.MAX_LENGTH_BONUS))
    up = own.select(key, score.alias("s"), F.posexplode(F.slice(F.reverse("path"), 1, rules.ANCESTORS)).alias("level", "node_id"))
    share = F.col("s") / F.when(F.col("level") == 0, 1).when(F.col("level") == 1, 2).otherwise(3 * F.col("level"))
    sums = up.groupBy(key, "node_id").agg(F.sum(share).alias("shares"))
    initial = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.INITIAL_SCORES.items() for x in kv]), F.col("tag")), F.lit(0.0))
    weight = T.class_weight(F.try_element_at("attrs", F.lit("class")), F.try_element_at("attrs", F.lit("id"))) if weigh_classes else F.lit(0)
    both = sums.join(nodes.select(key, "node_id", "tag", "attrs", "text_bytes", "link_bytes"), [key, "node_id"])
    scored = both.withColumn("score", F.col("shares") + initial + weight)
    return scored.select(key, "node_id", "tag", "score", (F.col("score") * (1 - link_density())).alias("adjusted"))


def top_candidates(scores: DataFrame, key: str = "page_id", k: int = 1) -> DataFrame:
    """The k best candidates of each page; ties go to the first in document order."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("adjusted", 9)), "node_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def siblings_of_top(nodes: DataFrame, scores: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, tag, is_top): the top candidate and those siblings that belong to it, by score or as a good paragraph."""
    top = top_candidates(scores, key).select(key, F.col("node_id").alias("top_id"), F.col("adjusted").alias("top_score"))
    at = nodes.select(key, F.col("node_id").alias("top_id"), F.col("parent_id").alias("top_parent"), F.try_element_at("attrs", F.lit("class")).alias("top_class"))
    top = top.join(at, [key, "top_id"])
    own = nodes.join(top, key).where((F.col("node_id") == F.col("top_id")) | (F.col("parent_id") == F.col("top_parent")))
    own = own.join(scores.select(key, "node_id", "adjusted"), [key, "node_id"], "left")
    share = F.col("top_score") * rules.SIBLING_SHARE
    threshold = F.when(F.col("top_score") <= 0, F.lit(rules.MIN_SIBLING_SCORE)).otherwise(share)
    cls = F.try_element_at("attrs", F.lit("class"))
    bonus = F.when((cls != "") & (cls == F.col("top_class")), share).otherwise(0.0)
    size, density = F.col("text_bytes"), link_density()
    good = (F.col("tag") == "p") & (
        ((size > rules.PARAGRAPH_BYTES) & (density < rules.PARAGRAPH_LINK_DENSITY))
        | ((size > 0) & (size < rules.PARAGRAPH_BYTES) & (density == 0) & F.col("text").rlike(r"\.( |$)"))
    )
    is_top = F.col("node_id") == F.col("top_id")
    return own.where(is_top | (F.col("adjusted") + bonus >= threshold) | good).select(key, "node_id", "tag", is_top.alias("is_top"))


def main_content(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, tag, score): the node of the best content score among divs, articles, sections, mains and the body."""
    scored = nodes.where(F.col("tag").isin("div", "article", "section", "main", "body")).withColumn("score", content_node_score())
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "node_id")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "node_id", "tag", "score")


def _count(tag: str) -> Column:
    return F.coalesce(F.try_element_at("tag_counts", F.lit(tag)), F.lit(0))


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def content_density() -> Column:
    """Text, paragraph, sentence and word density of a node, boosted or damped by its class and identifier."""
    size, words, sentences = F.col("text_bytes"), T.count_words("text"), T.count_sentences("text")
    per = lambda n, scale: F.when(size > 0, n / size * scale).otherwise(0.0)
    base = size / F.greatest("html_bytes", F.lit(1)) * 50 + per(_count("p"), 1000) * 20 + per(sentences, 1000) * 15 + per(words, 100) * 15
    boost = 1.0 + F.when(T.has_word(_attr("id"), rules.CONTENT_WORDS), 5.0).otherwise(0.0) + F.when(T.has_word(_attr("class"), rules.CONTENT_WORDS), 3.0).otherwise(0.0)
    bad = T.has_word(_attr("id"), rules.NON_CONTENT_WORDS) | T.has_word(_attr("class"), rules.NON_CONTENT_WORDS)
    return base * F.when(bad, boost * 0.5).otherwise(boost)


def density_measures() -> dict[str, Column]:
    """Single densities of a node by name."""
    size, full = F.col("text_bytes"), F.greatest("html_bytes", F.lit(1))
    heads = sum((_count(f"h{i}") for i in range(1, 7)), F.lit(0))
    per = lambda n: F.when(size > 0, n / size * 1000).otherwise(0.0)
    return {
        "text_to_code": size / full,
        "link_score": F.when(size > 0, 1 - link_density()).otherwise(0.0),
        "heading_density": per(heads),
        "list_density": per(_count("li")),
        "image_density": _count("img") / full * 1000,
        "content_density": content_density(),
    }


def content_node_score() -> Column:
    m = density_measures()
    bonus = (
        F.when(F.col("tag").isin("article", "section", "div", "main"), 10.0)
        .when(F.col("tag").isin("p", "pre", "td"), 5.0)
        .when(F.col("tag").isin("blockquote", "address", "ol", "ul", "dl", "dd", "dt", "li"), 3.0)
        .when(F.col("tag").isin("form", "aside", "footer", "header", "nav"), -10.0)
        .otherwise(0.0)
    )
    return m["content_density"] * m["link_score"] + m["heading_density"] * 10 + m["list_density"] * 5 + m["image_density"] * 3 + bonus + _count("p") * 5.0 + _count(CAPTIONED) * 10.0


def tables(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, rows, columns, cells, nesting, kind): each table's shape and whether it holds data, lays out, or navigates."""
    t = nodes.where(F.col("tag") == "table")
    nesting = F.size(F.filter("path_tags", lambda x: x == "table"))
    marking = nodes.where(F.col("tag").isin("caption", *rules.DATA_TABLE_TAGS)).select(key, "tag", "text", F.explode(F.arrays_zip("path", "path_tags")).alias("at"))
    inside = marking.where(F.col("at.path_tags") == "table").select(key, F.col("at.path").alias("table_id"), "tag", "text")
    in_table = nodes.where(F.col("tag").isin("td", "th")).select(key, "attrs", "path", "path_tags")
    steps = in_table.select(key, "attrs", F.explode(F.arrays_zip("path", "path_tags")).alias("at"), "path", "path_tags").where(F.col("at.path_tags") == "table")
    below = F.filter(F.arrays_zip("path", "path_tags"), lambda x: (x["path_tags"] == "tr") & (x["path"] > F.col("at.path")))
    cells = steps.select(key, F.col("at.path").alias("table_id"), "attrs", F.explode(F.transform(below, lambda x: x["path"])).alias("row_id"))
    span = F.coalesce(F.try_element_at("attrs", F.lit("colspan")).try_cast("int"), F.lit(1))
    by_row = cells.groupBy(key, "table_id", "row_id").agg(F.count("*").alias("n"), F.sum(span).alias("wide"))
    shape = by_row.groupBy(key, "table_id").agg(F.max("wide").cast("int").alias("columns"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("filled"))
    marks = inside.groupBy(key, "table_id").agg(F.max(F.col("tag").isin(*rules.DATA_TABLE_TAGS)).alias("headed"), F.max((F.col("tag") == "caption") & (F.col("text") != "")).alias("captioned"))
    own = t.select(key, F.col("node_id").alias("table_id"), "attrs", "tag_counts", "text_bytes", "link_bytes", nesting.alias("nesting"))
    own = own.join(shape, [key, "table_id"], "left").join(marks, [key, "table_id"], "left")
    rows, cell_n = _count("tr"), _count("td") + _count("th")
    columns = F.coalesce("columns", F.lit(0))
    name = F.concat(_attr("class"), F.lit(" "), _attr("id"))
    layout = (_attr("role") == "presentation") | (_attr("datatable") == "0") | T.has_word(name, rules.LAYOUT_TABLE_WORDS) | (
        (_attr("width") == "100%") & _attr("border").isin("", "0") & _attr("cellspacing").isin("", "0")
    )
    even = (rows >= 2) & (F.col("least") == F.col("most")) & (F.col("least") > 1) & (F.col("filled") == rows)
    data = (_attr("summary") != "") | F.coalesce("captioned", F.lit(False)) | F.coalesce("headed", F.lit(False)) | T.has_word(name, rules.DATA_TABLE_WORDS) | F.coalesce(even, F.lit(False))
    density = F.when(F.col("text_bytes") == 0, 0.0).otherwise(F.col("link_bytes") / F.col("text_bytes"))
    nav = (density > rules.NAV_TABLE_DENSITY) | T.has_word(name, rules.NAV_TABLE_WORDS) | ((_count("li") > 3) & (_count("a") >= F.floor(_count("li") * 0.8)))
    big = (rows >= rules.DATA_TABLE_ROWS) | (columns > rules.DATA_TABLE_COLUMNS) | (cell_n > rules.DATA_TABLE_CELLS)
    kind = (
        F.when(layout, "layout").when(data, "data").when(nav, "nav").when(F.col("nesting") > rules.TABLE_NESTING, "layout").when(big, "data")
        .when((F.col("text_bytes") > rules.LAYOUT_TABLE_TEXT) & (density < 0.3), "data").otherwise("layout")
    )
    return own.select(key, F.col("table_id").alias("node_id"), rows.alias("rows"), columns.alias("columns"), cell_n.alias("cells"), "nesting", kind.alias("kind"))


def images(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, src, alt, width, height, title, caption, relevant): images with their captions and whether they belong to the content."""
    captions = nodes.where(F.col("tag") == "figcaption").select(key, F.col("parent_id").alias("figure_id"), F.col("text").alias("figcaption"))
    i = nodes.where(F.col("tag") == "img").withColumn("figure_at", F.array_position(F.reverse("path_tags"), "figure").cast("int"))
    i = i.withColumn("figure_id", F.when(F.col("figure_at") > 0, F.try_element_at(F.reverse("path"), F.col("figure_at"))))
    i = i.join(captions, [key, "figure_id"], "left")
    named = F.contains(_attr("id"), F.lit(rules.IMAGE_AREA_PART)) | F.contains(_attr("class"), F.lit(rules.IMAGE_AREA_PART))
    whole = F.arrays_overlap(F.split(_attr("class"), r"\s+"), F.array(*map(F.lit, rules.IMAGE_AREA_CLASSES)))
    areas = nodes.where(F.col("tag").isin(*rules.IMAGE_AREA_TAGS) | named | whole).select(key, F.col("node_id").alias("area_id"))
    within = i.select(key, "node_id", F.explode("path").alias("area_id")).join(areas, [key, "area_id"]).select(key, "node_id").distinct()
    i = i.join(within.withColumn("in_content", F.lit(True)), [key, "node_id"], "left").withColumn("in_content", F.coalesce("in_content", F.lit(False)))
    alt, src = _attr("alt"), F.lower(_attr("src"))
    caption = F.coalesce(*[F.when(c != "", c) for c in (F.coalesce("figcaption", F.lit("")), alt, _attr("title"), _attr("aria-label"))])
    number = lambda n: _attr(n).try_cast("int")
    small = number("width").between(1, 99) & number("height").between(1, 99)
    decorative = F.lit(False)
    for part in rules.DECORATIVE_IMAGES:
        decorative = decorative | F.contains(src, F.lit(part))
    generic = F.lower(alt).isin("", *rules.GENERIC_ALT)
    classes = F.split(_attr("class"), r"\s+")
    background = (_attr("role") == "presentation") | F.arrays_overlap(classes, F.array(*map(F.lit, rules.BACKGROUND_CLASSES))) | F.contains(_attr("style"), F.lit("background-image"))
    relevant = (
        F.when(F.coalesce(small, F.lit(False)), False).when(decorative, False).when(~generic, True).when(F.col("figcaption").isNotNull(), True)
        .when(F.col("in_content"), True).when(background, False).otherwise(True)
    )
    return i.select(key, "node_id", _attr("src").alias("src"), alt.alias("alt"), number("width").alias("width"), number("height").alias("height"), _attr("title").alias("title"), caption.alias("caption"), relevant.alias("relevant"))


def links(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, href, text, important): each address of a page once, at its first place."""
    a = nodes.where(F.col("tag") == "a").select(key, "node_id", _attr("href").alias("href"), "text")
    w = Window.partitionBy(key, "href").orderBy("node_id")
    a = a.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return a.withColumn("important", T.is_important_link("text"))


def headings(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, level, kept_level, text, first): headings; kept_level falls by one level at most from the heading before; first marks the first of each text."""
    h = nodes.where(F.col("tag").rlike("^h[1-6]$")).select(key, "node_id", F.substring("tag", 2, 1).cast("int").alias("level"), "text")
    in_order = Window.partitionBy(key).orderBy("node_id")
    so_far = F.collect_list("level").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    kept = F.aggregate(so_far, F.lit(0), lambda last, x: F.when((last > 0) & (x > last + 1), last + 1).otherwise(x))
    first = F.row_number().over(Window.partitionBy(key, F.trim("text")).orderBy("node_id")) == 1
    return h.select(key, "node_id", "level", kept.alias("kept_level"), "text", first.alias("first"))


def typed_blocks(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, kind, level, place, text, metadata): paragraphs, then headings by level, list items and quotes, each in document order."""
    kind = (
        F.when(F.col("tag") == "p", F.struct(F.lit(0).alias("o"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level")))
        .when(F.col("tag").rlike("^h[1-6]$"), F.struct(F.lit(1).alias("o"), F.lit("heading").alias("kind"), F.substring("tag", 2, 1).cast("int").alias("level")))
        .when(F.col("tag") == "li", F.struct(F.lit(2).alias("o"), F.lit("list-item").alias("kind"), F.lit(0).alias("level")))
        .when(F.col("tag") == "blockquote", F.struct(F.lit(3).alias("o"), F.lit("blockquote").alias("kind"), F.lit(0).alias("level")))
    )
    b = nodes.withColumn("k", kind).where(F.col("k").isNotNull() & (F.col("text") != ""))
    place = F.row_number().over(Window.partitionBy(key).orderBy("k.o", "k.level", "node_id")) - 1
    listed = F.when(F.array_contains("path_tags", "ol"), "ordered").otherwise("unordered")
    meta = F.when(F.col("k.kind") == "list-item", F.create_map(F.lit("list-type"), listed)).otherwise(F.create_map().cast("map<string,string>"))
    return b.select(key, F.col("k.kind").alias("kind"), F.col("k.level").alias("level"), place.alias("place"), "text", meta.alias("metadata"))


def node_indexes(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, node_index): each node's place by the numbers of siblings from 1; the body is 0."""
    steps = nodes.select(key, "node_id", (F.col("ord") + 1).cast("string").alias("step"))
    up = nodes.select(key, F.col("node_id").alias("own"), F.posexplode(F.concat("path", F.array("node_id"))).alias("i", "node_id"))
    joined = up.join(steps, [key, "node_id"]).groupBy(key, "own").agg(F.array_sort(F.collect_list(F.struct("i", "step"))).alias("s"))
    tail = F.transform(F.filter("s", lambda x, i: i > 0), lambda x: x["step"])
    return joined.select(key, F.col("own").alias("node_id"), F.concat_ws(".", F.lit("0"), F.concat_ws(".", tail)).alias("node_index")).withColumn("node_index", F.regexp_replace("node_index", r"\.$", ""))


def selector_scores(nodes: DataFrame, selectors: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, value, score, selectors): values of attributes or texts that weighted selectors hit; equal values add their scores. selectors:
    (selector, tag, attribute, word, value_of, score) with null for any tag or attribute, and text or an attribute's name in value_of."""
    small = F.broadcast(selectors) if selectors.limit(MOST_SELECTORS + 1).count() <= MOST_SELECTORS else selectors
    s = small.select(F.coalesce("tag", F.lit("")).alias("_tag"), F.coalesce("attribute", F.lit("")).alias("_attribute"), "word", "value_of", "score", "selector")
    # an equal join: each node by its tag or none, and each of its attributes or none
    pairs = F.concat(F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value"))), F.map_entries("attrs"))
    n = nodes.select(key, "attrs", "text", F.explode(pairs).alias("x"), "tag").select(key, "attrs", "text", F.col("x.key").alias("_attribute"), F.col("x.value").alias("_held"), F.explode(F.array("tag", F.lit(""))).alias("_tag"))
    both = n.join(s, ["_tag", "_attribute"]).where((F.col("_attribute") == "") | F.contains("_held", "word"))
    value = F.when(F.col("value_of") == "text", F.col("text")).otherwise(F.try_element_at("attrs", F.col("value_of")))
    found = both.select(key, F.trim(value).alias("value"), "score", "selector").where("value != ''")
    return found.groupBy(key, "value").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("selector")).alias("selectors"))


@F.udtf(returnType="node_id int, parent_id int, depth int, tag string, text string", useArrow=False)
class DomNodes:
    """The elements of a page's body, as rows."""

    def eval(self, html: str):
        for r in page_nodes(html) if html else ():
            yield r["node_id"], r["parent_id"], r["depth"], r["tag"], r["text"]


def register(spark: SparkSession) -> None:
    """The table function dom_nodes for SQL."""
    spark.udtf.register("dom_nodes", DomNodes)
