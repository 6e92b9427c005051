"""Dates in texts as column expressions: cascades of formats, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import Text, _c

#: Formats with a time or zone, then plain ones, in the order in which they are tried.
ISO_FORMATS = (
    ("yyyy-MM-dd'T'HH:mm:ssXXX", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([+-]\d\d:\d\d|Z)$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"),
    ("yyyy-MM-dd'T'HH:mm:ssxx", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d{4}$"),
    ("yyyy-MM-dd", r"^\d{4}-\d\d-\d\d$"),
    ("yyyy-MM-ddX", r"^\d{4}-\d\d-\d\dZ$"),
    ("yyyyMMdd'T'HHmmssX", r"^\d{8}T\d{6}Z$"),
)
#: Formats of mails with names of days and months; a zone by its name is UTC.
MAIL_FORMATS = (
    ("dd MMM yyyy HH:mm:ss", r"^[A-Z][a-z]{2}, (\d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d) [A-Z]{2,4}$"),
    ("dd MMM yyyy HH:mm:ss xx", r"^[A-Z][a-z]{2}, (\d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4})$"),
    ("dd MMM yy HH:mm", r"^(\d\d [A-Z][a-z]{2} \d\d \d\d:\d\d) [A-Z]{2,4}$"),
    ("dd MMM yy HH:mm xx", r"^(\d\d [A-Z][a-z]{2} \d\d \d\d:\d\d [+-]\d{4})$"),
    ("dd-MMM-yy HH:mm:ss", r"^[A-Z][a-z]{5,8}, (\d\d-[A-Z][a-z]{2}-\d\d \d\d:\d\d:\d\d) [A-Z]{2,4}$"),
)
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = r"(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"
#: Phrases around dates; the first occurrence of each is taken out, in this order.
AROUND = ("published:", "published ", "updated:", "updated ", "date:", "date ", "on ", "posted on ", "written on ", "on date ", "as of ", "posted ", "written ")
#: Units of relative dates in seconds.
UNITS = (("(?:minute|min)s?", 60), ("(?:hour|hr)s?", 3600), ("days?", 86400), ("weeks?", 604800), ("months?", 2592000), ("years?", 31536000))
NAMED = (("yesterday", 86400), (r"last\s*week", 604800), (r"last\s*month", 2592000))


def _at(seconds: Column) -> Column:
    return F.date_trunc("second", seconds)


def parse_iso(value: Text) -> Column:
    """Instants in ISO and mail formats, cut to the second."""
    t = F.trim(_c(value))
    whole = F.regexp_replace(t, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)\.\d+", "$1")
    tries = [F.when(whole.rlike(p), F.try_to_timestamp(whole, F.lit(f))) for f, p in ISO_FORMATS]
    for f, p in MAIL_FORMATS:
        own, year = F.regexp_extract(t, p, 1), r"^(\d\d[ -][A-Z][a-z]{2}[ -])(\d\d)(?=[ ])"
        if "yyyy" not in f:  # two digits of the year: 1969 to 2068
            century = F.when(F.regexp_extract(own, year, 2).try_cast("int") < 69, "20").otherwise("19")
            own, f = F.concat(F.regexp_extract(own, year, 1), century, F.substring(own, 8, 100)), f.replace("yy", "yyyy")
        tries.append(F.when(t.rlike(p), F.try_to_timestamp(own, F.lit(f))))
    return _at(F.coalesce(*tries))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("y-M-d")).cast("date")


def _group(t: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(t, pattern, i)


def _int(c: Column) -> Column:
    return F.expr("null").cast("int") if c is None else F.when(c != "", c).cast("int")


def parse_regional(value: Text) -> Column:
    """Numeric dates, month before day where both fit; year first; with an optional time."""
    t = F.trim(_c(value))
    p = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?: (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([AP]M))?)?$"
    a, b, y = (_int(_group(t, p, i)) for i in (1, 2, 3))
    y = F.when(y < 69, y + 2000).when(y < 100, y + 1900).otherwise(y)
    h, mi, s, half = _int(_group(t, p, 4)), _int(_group(t, p, 5)), F.coalesce(_int(_group(t, p, 6)), F.lit(0)), _group(t, p, 7)
    h = F.when(half == "PM", h % 12 + 12).when(half == "AM", h % 12).otherwise(h)
    day = F.coalesce(_date(y, a, b), _date(y, b, a))
    q = r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$"
    y2, m2, d2 = (_int(_group(t, q, i)) for i in (1, 2, 3))
    whole = F.coalesce(day, _date(y2, m2, d2), _date(y2, d2, m2))
    seconds = F.coalesce(h * 3600 + mi * 60 + s, F.lit(0))
    return F.timestamp_seconds(F.unix_date(whole).cast("bigint") * 86400 + seconds)


def parse_natural(value: Text) -> Column:
    """English month names: March 5th, 2021; 5 March 2021; 2021 March 5. Days past the month's end run on into the next."""
    t = F.lower(F.trim(_c(value)))
    forms = (
        (rf"{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}|\d{{2}})\b", 1, 2, 3),
        (rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH}\.?,?\s+(\d{{4}}|\d{{2}})\b", 2, 1, 3),
        (rf"(\d{{4}})\s+{_MONTH}\.?\s+(\d{{1,2}})\b", 2, 3, 1),
    )
    out = []
    for p, im, id_, iy in forms:
        name, d, y = _group(t, p, im), _int(_group(t, p, id_)), _int(_group(t, p, iy))
        m = F.array_position(F.array(*[F.lit(x[:3]) for x in _MONTHS]), F.substring(name, 1, 3)).cast("int")
        y = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
        out.append(F.when((name != "") & d.between(1, 31), F.date_add(F.make_date(y, m, F.lit(1)), d - 1)))
    return F.timestamp_seconds(F.unix_date(F.coalesce(*out)).cast("bigint") * 86400)


def parse_components(value: Text, last_year: int = 2100) -> Column:
    """Year, month and day anywhere in a text, then eight digits, year and month, a year alone."""
    t = _c(value)
    p1, p2, p3, p4 = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", r"(\d{4})(\d{2})(\d{2})", r"(\d{4})[/-](\d{1,2})", r"\b(\d{4})\b"
    y1, m1, d1 = (_int(_group(t, p1, i)) for i in (1, 2, 3))
    y2, m2, d2 = (_int(_group(t, p2, i)) for i in (1, 2, 3))
    y3, m3 = (_int(_group(t, p3, i)) for i in (1, 2))
    y4 = _int(_group(t, p4, 1))
    run = lambda y, m, d: F.when(m.between(1, 12) & d.between(1, 31), F.date_add(F.make_date(y, m, F.lit(1)), d - 1))
    whole = F.when(y1.isNotNull(), F.coalesce(run(y1, m1, d1), run(y1, d1, m1))).otherwise(
        F.coalesce(run(y2, m2, d2), F.when(m3.between(1, 12), F.make_date(y3, m3, F.lit(1))), F.when(y4.between(1990, last_year), F.make_date(y4, F.lit(1), F.lit(1))))
    )
    return F.timestamp_seconds(F.unix_date(whole).cast("bigint") * 86400)


def cleanup_date(value: Text) -> Column:
    """Without tags and without the first occurrence of each phrase that stands around dates."""
    t = F.regexp_replace(F.regexp_replace(F.trim(_c(value)), "<[^>]*>", " "), r"\s+", " ")
    for phrase in AROUND:  # anchored at the start, so that only the first occurrence goes
        t = F.regexp_replace(t, f"(?i)^(.*?){phrase}", "$1")
    return F.trim(t)


def parse_flexible(value: Text) -> Column:
    """Cleaned, then ISO, regional, natural and component parsers in turn."""
    t = cleanup_date(value)
    return F.coalesce(parse_iso(t), parse_regional(t), parse_natural(t), parse_components(t))


def with_dates(rows: DataFrame, value: str, name: str = "instant") -> DataFrame:
    """The rows with the instant of a written date by all parsers in turn. Each parser is a projection of its own, so that the cleaned text is worked out once
    and the generated code stays small."""
    out = rows.withColumn("_text", cleanup_date(value)).withColumn("_iso", parse_iso("_text")).withColumn("_regional", parse_regional("_text"))
    out = out.withColumn("_natural", parse_natural("_text")).withColumn("_parts", parse_components("_text"))
    return out.withColumn(name, F.coalesce("_iso", "_regional", "_natural", "_parts")).drop("_text", "_iso", "_regional", "_natural", "_parts")


def parse_relative(value: Text, as_of: Column) -> Column:
    """Phrases such as 2 days ago and yesterday, counted back from as_of; months of 30 and years of 365 days."""
    t = F.lower(_c(value))
    tries = [F.when(t.rlike(rf"\d+\s*{p}\s*ago"), _int(_group(t, rf"(\d+)\s*{p}\s*ago", 1)).cast("bigint") * s) for p, s in UNITS]
    tries += [F.when(t.rlike(p), F.lit(s).cast("bigint")) for p, s in NAMED]
    return F.date_trunc("second", F.timestamp_seconds(F.unix_timestamp(as_of) - F.coalesce(*tries)))
