"""Types of the records that the operators give."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

BLOCK = StructType([StructField("text", StringType()), StructField("node_index", StringType()), StructField("content_digest", StringType())])
ARTICLE = StructType(
    [
        StructField("title", StringType()),
        StructField("byline", StringType()),
        StructField("date", TimestampType()),
        StructField("content", StringType()),
        StructField("plain_content", StringType()),
        StructField("plain_text", ArrayType(BLOCK)),
        StructField("content_type", IntegerType()),
        StructField("excerpt", StringType()),
        StructField("site_name", StringType()),
        StructField("lang", StringType()),
        StructField("text_content", StringType()),
        StructField("length", IntegerType()),
        StructField("error", StringType()),
    ]
)
NODE = StructType(
    [
        StructField("node_id", IntegerType()),
        StructField("parent_id", IntegerType()),
        StructField("path", ArrayType(IntegerType())),
        StructField("path_tags", ArrayType(StringType())),
        StructField("depth", IntegerType()),
        StructField("ord", IntegerType()),
        StructField("tag", StringType()),
        StructField("attrs", MapType(StringType(), StringType())),
        StructField("own_text", StringType()),
        StructField("text", StringType()),
        StructField("text_bytes", IntegerType()),
        StructField("html_bytes", IntegerType()),
        StructField("link_bytes", DoubleType()),
        StructField("comma_count", IntegerType()),
        StructField("tag_counts", MapType(StringType(), IntegerType())),
        StructField("visible", BooleanType()),
    ]
)
KEY = LongType()
