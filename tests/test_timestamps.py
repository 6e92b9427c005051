import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.operators import timestamps as T


def utc(value, zone="UTC", order="dmy"):
    s = T.to_utc_seconds(pd.Series([value]), pd.Series([zone]), pd.Series([order]))[0]
    return None if s is pd.NA else pd.Timestamp(int(s), unit="s").strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.mark.parametrize(
    "value, zone, order, expected",
    [
        ("2023-03-27T15:04:05+02:00", "UTC", "dmy", "2023-03-27T13:04:05Z"),
        ("2023-03-27T15:04:05.987654Z", "UTC", "dmy", "2023-03-27T15:04:05Z"),
        ("2021-09-18T01:47:38+02:00[Europe/Paris]", "Europe/Paris", "dmy", "2021-09-17T23:47:38Z"),
        ("2022-05-11 13:45:05 Europe/Berlin", "Asia/Tokyo", "ymd", "2022-05-11T11:45:05Z"),
        ("1700000000", "UTC", "dmy", "2023-11-14T22:13:20Z"),
        ("1700000000123", "UTC", "dmy", "2023-11-14T22:13:20Z"),
        ("20220521T221546+0200", "UTC", "dmy", "2022-05-21T20:15:46Z"),
        ("20230815", "Asia/Tokyo", "ymd", "2023-08-15T00:00:00Z"),
        ("24/01/2024", "Europe/London", "dmy", "2024-01-24T00:00:00Z"),
        ("01/24/2024", "America/New_York", "mdy", "2024-01-24T00:00:00Z"),
        ("03/09/20 11:30:06", "America/Chicago", "mdy", "2020-03-09T16:30:06Z"),
        ("25. Oktober 2020", "Europe/Berlin", "dmy", "2020-10-25T00:00:00Z"),
        ("16. März 2023 13:58 Uhr", "Europe/Berlin", "dmy", "2023-03-16T12:58:00Z"),
        ("11. Dezember 2022, 11:48 (UTC+1)", "Europe/Berlin", "dmy", "2022-12-11T10:48:00Z"),
        ("29. April 2018 16:07 MESZ", "Europe/Berlin", "dmy", "2018-04-29T14:07:00Z"),
        ("15 августа 2023 г. 14:39:01", "Europe/Moscow", "dmy", "2023-08-15T11:39:01Z"),
        ("14 avril 2019, 4h04", "Europe/Paris", "dmy", "2019-04-14T02:04:00Z"),
        ("Tue Mar  5 20:33:08 2019", "UTC", "dmy", "2019-03-05T20:33:08Z"),
        ("Posted on 12-05-2023, 05:10", "America/Chicago", "mdy", "2023-12-05T11:10:00Z"),
        ("2021-11-07 12:07 AM", "America/Los_Angeles", "mdy", "2021-11-07T07:07:00Z"),
        ("2024-02-29", "UTC", "dmy", "2024-02-29T00:00:00Z"),
        ("2023-02-29", "UTC", "dmy", None),
        ("31/04/2021", "UTC", "dmy", None),
        ("2022-03-27 02:18:00", "Europe/Berlin", "dmy", None),  # skipped by the zone
        ("2020-10-25 02:37", "Europe/Berlin", "dmy", None),  # repeated
        ("2020-10-25 02:37 MEZ", "Europe/Berlin", "dmy", "2020-10-25T01:37:00Z"),
        ("2020-10-25 02:37 JST", "Europe/Berlin", "dmy", None),
        ("0001-01-01T00:00:00Z", "UTC", "dmy", None),
        ("0000-00-00 00:00:00", "UTC", "dmy", None),
        ("2022-10", "UTC", "dmy", None),
        ("Published in 2019", "UTC", "dmy", None),
        ("3 hours ago", "UTC", "dmy", None),
        ("yesterday", "UTC", "dmy", None),
        ("", "UTC", "dmy", None),
        ("  ", "UTC", "dmy", None),
        (None, "UTC", "dmy", None),
        ("2023-03-27 25:00", "UTC", "dmy", None),
        ("x" * 20000, "UTC", "dmy", None),
        ("2023-03-27T15:04:05", None, None, None),
        ("2023-03-27T15:04:05Z", None, None, "2023-03-27T15:04:05Z"),
    ],
)
def test_values(value, zone, order, expected):
    assert utc(value, zone, order) == expected


def test_zone_tables_agree_with_the_zone_database():
    import datetime as dt
    import zoneinfo

    for zone in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata"):
        z = zoneinfo.ZoneInfo(zone)
        for s in range(1514764800, 1767225600, 86400 * 11 + 3607):
            local = dt.datetime.fromtimestamp(s, dt.timezone.utc).astimezone(z).replace(tzinfo=None)
            got, once = T.local_to_utc(pd.Series([int((local - dt.datetime(1970, 1, 1)).total_seconds())]).to_numpy(), zone)
            assert not once[0] or got[0] == s
    assert T.zone_version()


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_is_read_or_refused(text):
    T.to_utc_seconds(pd.Series([text]), pd.Series(["Europe/Berlin"]), pd.Series(["dmy"]))


def test_table(spark):
    rows = spark.createDataFrame(
        [(1, 1, "2020-01-01 10:00", "a"), (1, 1, "2020-01-01 10:00", "b"), (2, 9, "2020-01-01 10:00", "c"), (3, 9, "2020-01-01T10:00:00Z", "d"), (4, 1, None, "e"), (5, None, "soon", "f")],
        "article_id bigint, site_id int, date string, tz string",
    )
    sites = spark.createDataFrame([(1, "Asia/Tokyo", "ymd", "x"), (1, "Asia/Tokyo", "ymd", "x")], "site_id int, tz string, date_order string, utc string")
    got = {tuple(r) for r in T.normalise_timestamps(rows, sites).collect()}
    assert got == {(1, "2020-01-01T01:00:00Z"), (3, "2020-01-01T10:00:00Z")}
    assert T.normalise_timestamps(rows.limit(0), sites).count() == 0
    assert {tuple(r) for r in T.normalise_timestamps(rows, sites.limit(0)).collect()} == {(3, "2020-01-01T10:00:00Z")}
