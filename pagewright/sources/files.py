"""Pages from files and standard input; articles to JSON, HTML and text."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"json": ".json", "html": ".html", "text": ".txt"}


def pages_from_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, html): one row for each file, read whole; paths may be directories, globs or a comma-separated list."""
    own = [p.strip() for p in paths.split(",")] if isinstance(paths, str) else list(paths)
    return spark.read.text([p for p in own if p], wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def page_from_stdin(spark: SparkSession) -> DataFrame:
    """(path, html) of what stands on standard input."""
    return spark.createDataFrame([("-", sys.stdin.read())], "path string, html string")


def json_column(*columns: str) -> Column:
    """An article as JSON; fields without a value are left out."""
    return F.to_json(F.struct(*columns))


def text_column(blocks: str = "plain_text") -> Column:
    """The blocks' texts, an empty line after each."""
    texts = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    return F.when(F.size(blocks) > 0, F.concat(texts, F.lit("\n\n"))).otherwise("")


def output_column(form: str) -> Column:
    """An article in one of FORMATS."""
    if form not in FORMATS:
        raise ValueError(f"the format is one of {', '.join(FORMATS)}, not {form}")
    if form == "json":
        fields = ("title", "byline", "date", "content", "plain_content", "plain_text", "content_type")
        return json_column(*fields)
    return F.coalesce(F.col("content"), F.lit("")) if form == "html" else text_column()


def write_articles(articles: DataFrame, path: str, form: str = "json", mode: str = "error") -> None:
    """Articles written by the executors: text files of one record a line (JSON), or one file for each article (html, text), named after its path below a
    folder that all executors share. Two articles of one path write one file, the last of them."""
    if form == "json":
        articles.select(output_column("json").alias("value")).write.mode(mode).text(path)
        return
    root, suffix = path.removeprefix("file://").rstrip("/"), {"html": ".html", "text": ".txt"}[form]
    if mode == "error" and os.path.exists(root):
        raise FileExistsError(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, value in zip(pdf["path"], pdf["value"]):
                own = re.sub(r"^[a-z]+:/*", "", source or "page").lstrip("/")
                to = os.path.normpath(os.path.join(root, os.path.splitext(own)[0] + suffix))
                if not to.startswith(root + os.sep):
                    raise ValueError(f"{source} leads out of the folder")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{os.getpid()}.part"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(value)
                os.replace(part, to)
            yield pdf[["path"]]

    os.makedirs(root, exist_ok=True)
    articles.select("path", output_column(form).alias("value")).mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()
