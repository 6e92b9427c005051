"""Queries of the operators that prepare text for training language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import boilerplate, bpe, garbled, languages, lookalikes, markup, packing, quality, residue
from pagewright.sources.tables import table


def _dictionaries(spark: SparkSession, d: str) -> tuple:
    return garbled.dictionaries_of(table(spark, d, "lang_sample"), table(spark, d, "lexicon"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, field, block_no): values that hold characters other than the ordinary ones they look like."""
    return lookalikes.differing_values(table(spark, d, "article"), _dictionaries(spark, d)).select("article_id", "field", "block_no")


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, title, byline, blocks): the consistent form of every title, byline and block; one row for each delivery."""
    return lookalikes.consistent_articles(table(spark, d, "article"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, node_no): child elements of the root of plain_content that don't belong to the main body."""
    return boilerplate.boilerplate_elements(table(spark, d, "article"), table(spark, d, "site"))


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, content_body, body): the main body of each article's content and plain_content."""
    return boilerplate.main_bodies(table(spark, d, "article"), table(spark, d, "site"))


def p2_template(spark: SparkSession, d: str) -> DataFrame:
    """(host, lang, stories, size, atoms): the valid equivalence classes of each host's template."""
    return boilerplate.template_classes(table(spark, d, "article"), table(spark, d, "site"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(article_id): articles with a placeholder, filler, a message or a notice where real content belongs."""
    return residue.residue_articles(table(spark, d, "article"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, block_no): blocks of 120 or more characters that are a list, a table or junk instead of sentences."""
    return quality.other_than_prose(table(spark, d, "article"), table(spark, d, "lang_sample"), table(spark, d, "lexicon"))


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of the text of every plain_content and of every block, and the kind of each long block."""
    return quality.text_kinds(table(spark, d, "article"), table(spark, d, "lang_sample"), table(spark, d, "lexicon"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, block_no): blocks whose text shows markup or entities."""
    return markup.marked_articles(table(spark, d, "article"), markup.fit_on(table(spark, d, "lang_sample")))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, content, plain_content, blocks, found): the clean form of every content, plain_content and block; one row for each delivery."""
    return markup.cleaned_articles(table(spark, d, "article"), markup.fit_on(table(spark, d, "lang_sample")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, field, block_no): wrongly decoded titles and blocks."""
    return garbled.restored_values(table(spark, d, "article"), _dictionaries(spark, d)).select("article_id", "field", "block_no")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, field, block_no, value, restored, chain): wrongly decoded values with what could be had back."""
    return garbled.restored_values(table(spark, d, "article"), _dictionaries(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids): the ids of each document by byte_bpe_50k."""
    return bpe.encode_texts(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): the documents back from their ids; a null text comes back empty."""
    return bpe.decode_ids(p8_ids(spark, d))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """(spec_id, doc_id, piece_no, first_token, tokens, container_id): the documents in containers of each specification."""
    return packing.packed(table(spark, d, "documents"), table(spark, d, "container_spec"))


def _profiles(spark: SparkSession, d: str) -> tuple:
    return languages.profiles_of(table(spark, d, "lang_sample"), table(spark, d, "lexicon"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang): each document and language that holds five lines of it or more and that its label doesn't name."""
    return languages.unlabelled_languages(table(spark, d, "documents"), _profiles(spark, d))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """Each document's language, confidence, lines by language and stretches of one language."""
    return languages.document_languages(table(spark, d, "documents"), _profiles(spark, d)).select(
        "doc_id", "language", "confidence", languages.sorted_counts("line_counts").alias("line_counts"), "segments"
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_consistent, p2_found, p2_bodies, p2_template, p3_found, p5_found, p5_statistics, p6_found, p6_cleaned, p7_found, p7_restored, p8_ids, p8_decoded, p9_packed, p10_found, p10_languages)}
ORACLES = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
