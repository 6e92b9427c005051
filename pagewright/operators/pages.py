"""Single fields of pages as columns, for queries that need no whole extraction."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampType

from pagewright.operators.dates import page_byline, page_date
from pagewright.operators.dom import parse
from pagewright.operators.extract import article_title
from pagewright.session import cut, sent


def once(pages: DataFrame, key: str = "page_id", when: str = "fetched_at") -> DataFrame:
    """The pages, each key once: of several deliveries the earliest, of those of one time the one whose contents hash least. Only the keys are gathered, to
    find those delivered again; of the markup, only these rows move. Rows without a key count as one page."""
    again = sent(cut(pages.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n")).where("n > 1").select("_key")))
    same = F.col(key).eqNullSafe(F.col("_key"))
    repeated = pages.join(again, same, "left_semi")
    rank = F.struct(F.col(when), F.xxhash64(*pages.columns))
    chosen = repeated.groupBy(key).agg(F.min_by(F.struct(*pages.columns), rank).alias("row")).select("row.*")
    return pages.join(again, same, "left_anti").unionByName(chosen)


@F.pandas_udf(StringType())
def _byline(html: pd.Series) -> pd.Series:
    return html.map(page_byline, na_action="ignore")


@F.pandas_udf(StringType())
def _title(html: pd.Series) -> pd.Series:
    return html.map(lambda h: article_title(parse(h)) or None, na_action="ignore")


def _date_of(html: pd.Series, as_of: dt.datetime | None) -> pd.Series:
    return pd.to_datetime(html.map(lambda h: page_date(h, as_of), na_action="ignore"), utc=True)


def page_byline_column(html: Column | str) -> Column:
    """The author of a page by weighted selectors."""
    return _byline(html)


def page_title_column(html: Column | str) -> Column:
    """The title of a page by its headline or title element."""
    return _title(html)


def page_date_column(html: Column | str, as_of: dt.datetime | None = None) -> Column:
    """The date of a page by weighted selectors, relative ones counted from as_of."""

    @F.pandas_udf(TimestampType())
    def date(values: pd.Series) -> pd.Series:
        return _date_of(values, as_of)

    return date(html)
