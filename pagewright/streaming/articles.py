"""Articles from a stream of pages: the same narrow operator as on tables, after repeated deliveries within a watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagewright.operators.extract import extract_articles
from pagewright.options import ExtractOptions


def page_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Pages from parquet files as they arrive in a directory."""
    return spark.readStream.schema(schema).parquet(path)


def article_stream(pages: DataFrame, options: ExtractOptions = ExtractOptions(), delay: str = "1 hour") -> DataFrame:
    """(page_id, fetched_at, article fields) of each page once; a page that comes again within the delay is dropped, later ones count anew."""
    once = pages.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["page_id"])
    return extract_articles(once, options, keep=("page_id", "fetched_at"))


def write_stream(articles: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """The articles as parquet, exactly once by the checkpoint."""
    writer = articles.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
