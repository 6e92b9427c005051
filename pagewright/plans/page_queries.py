"""Queries of page extraction and of the relations over page nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import nodes as N
from pagewright.operators.extract import extract_articles
from pagewright.operators.simplify import restructured, simplified
from pagewright.operators.pages import once, page_date_column, page_title_column
from pagewright.options import ExtractOptions
from pagewright.session import cut, shared_folder
from pagewright.sources.tables import table

_P = "FROM pages WHERE html IS NOT NULL"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "pages").where(F.col("html").isNotNull()).select("page_id", "url", "html", "fetched_at"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return N.dom_nodes(_pages(spark, d))


def _written(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Columns of the nodes, written once, for relations that read them more than once: the pages are parsed only once."""
    return cut(_nodes(spark, d).select("page_id", "node_id", *columns))


def extract_pages(spark, d):
    """The article record of each page."""
    return extract_articles(_pages(spark, d), ExtractOptions(), url="url")


def extract_with_digests(spark, d):
    """Plain markup and blocks with node indexes and content digests."""
    out = extract_articles(_pages(spark, d), ExtractOptions(content_digests=True, node_indexes=True, preserve_important_links=True))
    return out.select("page_id", "plain_content", "plain_text", "content_type")


def page_titles(spark, d):
    return _pages(spark, d).select("page_id", page_title_column("html").alias("title"))


def page_dates(spark, d):
    return _pages(spark, d).select("page_id", page_date_column("html").alias("date"))


def page_text_blocks(spark, d):
    """(page_id, block_no, text): the blocks of the extracted articles."""
    out = extract_articles(_pages(spark, d)).select("page_id", F.posexplode("plain_text").alias("block_no", "b"))
    return out.select("page_id", "block_no", "b.text")


def dom_nodes(spark, d):
    return _nodes(spark, d).select("page_id", "node_id", "parent_id", "depth", "tag", "text_bytes", "link_bytes", "comma_count")


def dom_headings(spark, d):
    return N.headings(_nodes(spark, d))


def dom_links(spark, d):
    return N.links(_nodes(spark, d))


def node_index(spark, d):
    return N.node_indexes(_written(spark, d, "path", "ord"))


def candidate_scores(spark, d):
    return N.candidate_scores(_written(spark, d, "path", "tag", "attrs", "text_bytes", "link_bytes", "comma_count")).select("page_id", "node_id", "tag", F.round("score", 6).alias("score"), F.round("adjusted", 6).alias("adjusted"))


def top_candidates(spark, d):
    return N.top_candidates(N.candidate_scores(_written(spark, d, "path", "tag", "attrs", "text_bytes", "link_bytes", "comma_count")), k=5).select("page_id", "node_id", "tag", "rank")


def top_siblings(spark, d):
    nodes = _written(spark, d, "parent_id", "text", "path", "tag", "attrs", "text_bytes", "link_bytes", "comma_count")
    return N.siblings_of_top(nodes, N.candidate_scores(nodes))


def main_content(spark, d):
    return N.main_content(_nodes(spark, d)).select("page_id", "node_id", "tag", F.round("score", 6).alias("score"))


def node_densities(spark, d):
    nodes = _nodes(spark, d).where(F.col("tag").isin("div", "article", "section", "nav", "footer", "body"))
    return nodes.select("page_id", "node_id", "tag", *[F.round(c, 6).alias(k) for k, c in N.density_measures().items()])


def table_kinds(spark, d):
    return N.tables(_written(spark, d, "path", "path_tags", "tag", "attrs", "tag_counts", "text", "text_bytes", "link_bytes"))


def page_images(spark, d):
    return N.images(_written(spark, d, "parent_id", "path", "path_tags", "tag", "attrs", "text"))


def typed_blocks(spark, d):
    return N.typed_blocks(_nodes(spark, d)).select("page_id", "kind", "level", "place", "text")


def simplified_pages(spark, d):
    return _pages(spark, d).select("page_id", simplified("html").alias("html"))


def restructured_pages(spark, d):
    return _pages(spark, d).select("page_id", restructured("html").alias("html"))


def dom_hrefs(spark, d):
    """(page_id, href): addresses of links in the built tree; the SQL finds them in the markup."""
    return N.links(_nodes(spark, d)).select("page_id", "href")


def dom_item_texts(spark, d):
    """(page_id, text): texts of menu items in the built tree; the SQL finds them in the markup."""
    nodes = _nodes(spark, d).where((F.col("tag") == "li") & F.array_contains("path_tags", "nav"))
    return nodes.select("page_id", "text").distinct()


def stream_articles(spark, d):
    """(page_id): the pages whose articles a stream of the pages' files writes, each once."""
    from pagewright.streaming import articles as A

    schema = table(spark, d, "pages").schema
    folder = shared_folder("stream")
    pages = A.page_stream(spark, f"{d}/pages.parque[t]", schema).where(F.col("html").isNotNull())
    A.write_stream(A.article_stream(pages).select("page_id", "fetched_at", "title", "error"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("page_id bigint").parquet(f"{folder}/out").distinct()


_ONCE = "(SELECT page_id, min(html) AS html FROM pages WHERE html IS NOT NULL GROUP BY page_id)"
_ALL = (extract_pages, extract_with_digests, page_titles, page_dates, page_text_blocks, dom_nodes, dom_headings, dom_links, node_index, candidate_scores, top_candidates, top_siblings, main_content, node_densities, table_kinds, page_images, typed_blocks, simplified_pages, restructured_pages, dom_hrefs, dom_item_texts, stream_articles)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "stream_articles": f"SELECT DISTINCT page_id {_P}",
    "dom_hrefs": f"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM {_ONCE}""",
    "dom_item_texts": f"""SELECT DISTINCT page_id, regexp_replace(x, '<[^>]*>', '', 'g') AS text FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '(?s)<li[^>]*>(.*?)</li>', 1)) AS x FROM {_ONCE})""",
}
