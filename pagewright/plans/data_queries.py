"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.timestamps import normalise_timestamps, utc_instant, zone_version
from pagewright.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, utc): each article whose date names exactly one instant."""
    return normalise_timestamps(table(spark, d, "article"), table(spark, d, "site"))


def p4_instants(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, date, utc, zone_version): every distinct written date with its instant, null where it names none, and the version of the zones' tables."""
    sites = table(spark, d, "site").select("site_id", "tz", "date_order").dropDuplicates(["site_id"])
    dates = table(spark, d, "article").select("article_id", "site_id", "date").distinct().join(sites, "site_id", "left")
    return dates.select("article_id", "date", utc_instant("date", "tz", "date_order").alias("utc"), F.lit(zone_version()).alias("zone_version"))


def zone_cases(spark: SparkSession, d: str) -> DataFrame:
    """(date, zone, utc): written dates of all eras."""
    rows = spark.createDataFrame([(v, z) for v, z, _ in ZONE_CASES], "date string, zone string")
    return rows.select("date", "zone", utc_instant("date", "zone", F.lit("dmy")).alias("utc"))


#: Local times with what they are in UTC by the zones' history and rules; null where the zone skips or repeats the time.
ZONE_CASES = [
    ("1950-01-01 12:00:00", "Europe/London", "1950-01-01T12:00:00Z"), ("1950-07-01 12:00:00", "Europe/London", "1950-07-01T11:00:00Z"), ("1970-01-01 12:00:00", "Europe/London", "1970-01-01T11:00:00Z"),
    ("2150-07-01 12:00:00", "Europe/London", "2150-07-01T11:00:00Z"), ("2150-01-01 12:00:00", "Europe/London", "2150-01-01T12:00:00Z"), ("2950-07-01 12:00:00", "Europe/Berlin", "2950-07-01T10:00:00Z"),
    ("2021-03-28 02:30:00", "Europe/Berlin", None), ("2021-10-31 02:30:00", "Europe/Berlin", None), ("2021-10-31 03:00:00", "Europe/Berlin", "2021-10-31T02:00:00Z"), ("2020-07-01 12:00:00", "America/New_York", "2020-07-01T16:00:00Z"),
    ("1943-07-01 12:00:00", "America/New_York", "1943-07-01T16:00:00Z"), ("2020-01-01 12:00:00+05:30", "Europe/Berlin", "2020-01-01T06:30:00Z"), ("2020-01-01", "Asia/Tokyo", "2020-01-01T00:00:00Z"),
]


QUERIES = {f.__name__: f for f in (p4_found, p4_instants, zone_cases)}
ORACLES = {
    "zone_cases": "SELECT date, zone, CAST(utc AS VARCHAR) AS utc FROM (VALUES " + ", ".join(f"('{d}', '{z}', {f"'{u}'" if u else 'NULL'})" for d, z, u in ZONE_CASES) + ") AS v(date, zone, utc)",
}
