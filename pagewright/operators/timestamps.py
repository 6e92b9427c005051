"""Written timestamps to one UTC instant.

Each value is tokenised into a mask of character classes (runs of digits keep their
length; month, weekday, meridiem, zone and filler words become one class letter). A mask
is matched against the date grammar once per worker and gives a parser: the places of
year, month, day, time, offset and zone among the tokens. All values of one mask are then
converted together with numpy; local times go through zone transition tables that are
built from the time zone database and carry its version.

Defined results: null, blank, relative, impossible or day-less values give null; so do
local times that the zone skips or repeats, years 0 and 1, and zone abbreviations that
the zone never uses. Fractions of a second are cut off.
"""

from __future__ import annotations

import os
import re
import zoneinfo
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Month names and abbreviations by language, in order of the months.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en3": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "de3": "jan feb mär apr mai jun jul aug sep okt nov dez",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "fr3": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "es3": "ene feb mar abr may jun jul ago sep oct nov dic",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "pt3": "jan fev mar abr mai jun jul ago set out nov dez",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "ru1": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
}
#: Days of the week.
WEEKDAYS = frozenset(
    "mon tue tues wed thu thur thurs fri sat sun monday tuesday wednesday thursday friday saturday sunday "
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag lundi mardi mercredi jeudi vendredi samedi dimanche "
    "lunes martes miércoles jueves viernes sábado domingo segunda terça quarta quinta sexta feira "
    "понедельник вторник среда четверг пятница суббота воскресенье".split()
)
#: Words that join date and time or stand before or after either.
FILLERS = frozenset("at um à a las às às' в h uhr de del г on le el em the of am den y клок".split())
#: Words of labels in front of a date.
LABELS = frozenset(
    "published posted updated last modified date on created stand veröffentlicht aktualisiert am publié mis jour à le "
    "publicado actualizado atualizado el em опубликовано обновлено in".split()
)
#: Abbreviations that English zone data doesn't use, as offsets in minutes, by zone prefix.
EXTRA_ABBREVIATIONS = {"Europe/Berlin": {"MEZ": 60, "MESZ": 120}}
MONTH_OF = {w: i + 1 for names in MONTHS.values() for i, w in enumerate(names.split())}
MONTH_OF["sept"] = 9

_TOKEN = re.compile(r"\d+|[A-Z][A-Za-z]+(?:/[A-Z][A-Za-z_]+)+|[^\W\d_]+\.?|\s+|.", re.S)

#: The date grammar over masks. 9 a digit, B month, E weekday, P am or pm, U universal time, Z zone
#: abbreviation, I zone name, T the letter between day and time, F filler, O ordinal ending, H an h between hour and
#: minute, L a label; other signs stand for themselves.
_ZONE = (
    r"(?: ?\(?(?:(?P<u>U)(?:(?P<sign>[+-])(?:(?P<ohm>9999)|(?P<oh>99?)(?::(?P<om>99))?))?"
    r"|(?P<sign2>[+-])(?:(?P<ohm2>9999)|(?P<oh2>99)(?::(?P<om2>99))?)|(?P<abbr>Z)|(?P<iana>I))\)?(?:\[[IU]\])?)?"
)
_TIME = r"(?:(?:,? ?(?:F ?){0,3}|T|,? )(?P<h>99?)[:.H](?P<mi>99)(?:[:.](?P<s>99)(?:[.,]9{1,9})?)?(?: ?(?P<p>P))?(?: ?F)?)?"
_DATES = (
    r"(?P<y>9999)(?P<q>[-/.])(?P<m>99?)(?P=q)(?P<d>99?)",
    r"(?P<ymd>9{8})",
    r"(?:E,? )?(?P<d>99?)(?:O|\.)?[ -](?:F )?(?P<b>B)\.?(?: F|-|,)? ?(?P<y>9999)(?: ?F)?",
    r"(?:E,? )?(?P<b>B)\.? (?P<d>99?)O?,? (?P<y>9999)",
    r"(?P<y>9999) (?P<b>B) (?P<d>99?)O?",
    r"(?P<n1>99?)(?P<q>[-/.])(?P<n2>99?)(?P=q)(?P<ny>9999|99)",
)
_GRAMMAR = [re.compile(rf"{d}{_TIME}{_ZONE}") for d in _DATES] + [
    re.compile(rf"E (?P<b>B) (?P<d>99?) (?P<h>99):(?P<mi>99):(?P<s>99)(?: (?:(?P<u>U)|(?P<abbr>Z)))? (?P<y>9999)"),
    re.compile(rf"(?P<ymd>9{{8}})T(?P<hms>9{{6}}|9{{4}})(?:[.,]9{{1,9}})?{_ZONE}"),
    re.compile(r"(?P<ymdhms>9{14}|9{12})(?P<u>U)?"),
    re.compile(r"(?P<epoch>9{10})(?:\.9{1,9})?"),
    re.compile(r"(?P<ms>9{13})"),
    re.compile(r"(?P<us>9{16})"),
    re.compile(r"(?P<ns>9{19})"),
]
_LABEL = re.compile(r"(?:(?:L|F)(?: (?=[LF])|:? ?))*(?=[9BE])")


def _word_class(word: str, before: str, after: str) -> str:
    bare = word.rstrip(".").lower()
    if before.isdigit():
        if bare in ("st", "nd", "rd", "th", "er", "º", "ª") and word == word.lower():
            return "O"
        if bare == "t" and after.isdigit():
            return "T"
        if bare == "z" and not after.strip():
            return "U"
        if bare == "h" and after.isdigit():
            return "H"
    if bare in ("am", "pm", "a.m", "p.m") and (before.isdigit() or after == ""):
        return "P"
    if bare in MONTH_OF:
        return "B"
    if bare in WEEKDAYS:
        return "E"
    if word in ("UTC", "GMT", "UT"):
        return "U"
    if "/" in word:
        return "I"
    if bare in FILLERS:
        return "F"
    if bare in LABELS:
        return "L"
    if word.isupper() and 3 <= len(word) <= 5:
        return "Z"
    return "X"


def tokenise(value: str) -> tuple[str, list[str], list[int]]:
    """The mask of a value, its tokens, and each token's place in the mask."""
    tokens = [t if not t.isspace() else " " for t in _TOKEN.findall(value.strip())]
    mask, places, at = [], [], 0
    for i, t in enumerate(tokens):
        if t.isdigit():
            c = "9" * len(t)
        elif t[0].isalpha():
            before = tokens[i - 1] if i else ""
            if before == " " and i > 1 and t.rstrip(".").lower() in ("am", "pm"):
                before = tokens[i - 2]
            c = _word_class(t, before, tokens[i + 1] if i + 1 < len(tokens) else "")
        else:
            c = t
        places.append(at)
        mask.append(c)
        at += len(c)
    return "".join(mask), tokens, places


@cache
def parser_for(mask: str) -> dict[str, int] | None:
    """Field name to place in the mask, or None for a mask that names no instant. Cached: one call a mask and worker."""
    start = _LABEL.match(mask)
    at = start.end() if start else 0
    for grammar in _GRAMMAR:
        if m := grammar.fullmatch(mask, at):
            return {k: m.start(k) for k, v in m.groupdict().items() if v is not None and k != "q"}
    return None


def zone_version() -> str:
    """Version of the time zone database that the transition tables are built from."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        pass
    for folder in zoneinfo.TZPATH:
        path = os.path.join(folder, "tzdata.zi")
        if os.path.exists(path):
            with open(path, encoding="ascii", errors="replace") as f:
                return f.readline().split()[-1]
    return "system"


#: Years of the transition tables: those of most dates, those before, and one whole cycle of the calendar after, which stands for all later ones.
ERAS = {"main": (1968, 2101), "early": (1800, 1970), "late": (2099, 2502)}
#: Seconds of a cycle of the calendar, after which days, weekdays and so the rules of zones repeat.
CYCLE = 146_097 * 86_400


@cache
def transitions(zone: str, era: str = "main") -> tuple[np.ndarray, np.ndarray, dict[str, int]] | None:
    """UTC seconds from which each offset holds, the offsets in seconds, and the abbreviations' offsets.
    None for an unknown zone."""
    import datetime as dt

    try:
        z = zoneinfo.ZoneInfo(zone)
    except Exception:
        return None
    first, last = ERAS[era]
    utc = dt.timezone.utc
    at = lambda s: dt.datetime.fromtimestamp(s, utc).astimezone(z)
    off = lambda s: int(at(s).utcoffset().total_seconds())
    lo = int(dt.datetime(first, 1, 1, tzinfo=utc).timestamp())
    end = int(dt.datetime(last, 1, 1, tzinfo=utc).timestamp())
    starts, offsets, names = [-(2**62)], [off(lo)], {at(lo).tzname(): off(lo)} if era == "main" else {}
    step = 7 * 86400
    for s in range(lo, end, step):
        a, b = s, s + step
        if off(a) != off(b):
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if off(mid) == off(a) else (a, mid)
            starts.append(b)
            offsets.append(off(b))
        if era == "main" and s > 1262304000:  # abbreviations in use since 2010
            names[at(b).tzname()] = off(b)
    names |= {k: v * 60 for k, v in EXTRA_ABBREVIATIONS.get(zone, {}).items()}
    if offsets[-1] in (3600, 7200) and {"CET", "CEST"} & set(names):
        names |= {"MEZ": 3600, "MESZ": 7200}
    return np.array(starts, dtype=np.int64), np.array(offsets, dtype=np.int64), names


def local_to_utc(local: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of local seconds of any year, and whether each local time exists exactly once."""
    result, once = local.copy(), np.zeros(len(local), bool)
    bounds = {"early": (-(2**62), -31_536_000), "main": (-31_536_000, 4_102_444_800), "late": (4_102_444_800, 2**62)}  # 1969-01-01 and 2100-01-01
    for era, (lo, hi) in bounds.items():
        own = (local >= lo) & (local < hi)
        if own.any():
            # the late table holds the years from 2100 to 2499
            shift = (local[own] - lo) // CYCLE * CYCLE if era == "late" else 0
            utc, once[own] = _in_era(local[own] - shift, zone, era)
            result[own] = utc + shift
    return result, once


def _in_era(local: np.ndarray, zone: str, era: str) -> tuple[np.ndarray, np.ndarray]:
    table = transitions(zone, era)
    if table is None:
        return local, np.zeros(len(local), bool)
    starts, offsets, _ = table
    found, result = np.zeros(len(local), np.int64), local.copy()
    i = np.searchsorted(starts, local, side="right") - 1
    for k in (-1, 0, 1):
        j = np.clip(i + k, 0, len(starts) - 1)
        u = local - offsets[j]
        own = (np.searchsorted(starts, u, side="right") - 1 == j) & (j == i + k)
        result = np.where(own, u, result)
        found += own
    return result, found == 1


def _ints(values: list[list[str]], place: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    return np.array([v[place][lo:hi] for v in values]).astype(np.int64)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = (y >= 2) & (m >= 1) & (m <= 12) & (d >= 1)
    months = (np.where(ok, y, 2000) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    following = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (d <= following - first)


def _convert(fields: dict[str, int], tokens: list[list[str]], places: list[int], zones: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds and validity of values that share one mask."""
    tok = {p: i for i, p in enumerate(places)}
    at = {k: tok[p] for k, p in fields.items()}
    n = len(tokens)
    zero, ok = np.zeros(n, np.int64), np.ones(n, bool)
    for k, scale in (("epoch", 1), ("ms", 10**3), ("us", 10**6), ("ns", 10**9)):
        if k in at:
            return _ints(tokens, at[k]) // scale, ok
    h = mi = s = zero
    if "ymd" in at or "ymdhms" in at:
        p = at.get("ymd", at.get("ymdhms"))
        y, m, d = _ints(tokens, p, 0, 4), _ints(tokens, p, 4, 6), _ints(tokens, p, 6, 8)
        q, o = (at["hms"], 0) if "hms" in at else (p, 8)
        if "hms" in at or "ymdhms" in at:
            long = len(tokens[0][q]) - o == 6
            h, mi, s = _ints(tokens, q, o, o + 2), _ints(tokens, q, o + 2, o + 4), _ints(tokens, q, o + 4, o + 6) if long else zero
    elif "n1" in at:
        a, b, c = _ints(tokens, at["n1"]), _ints(tokens, at["n2"]), _ints(tokens, at["ny"])
        short = len(tokens[0][at["ny"]]) == 2
        dmy, ymd = orders == "dmy", (orders == "ymd") & short
        y = np.where(ymd, a + 2000, c + 2000 * short)
        m = np.where(dmy, b, np.where(ymd, b, a))
        d = np.where(dmy, a, np.where(ymd, c, b))
        ok &= np.isin(orders, ("dmy", "mdy")) | ymd
    else:
        y, d = _ints(tokens, at["y"]), _ints(tokens, at["d"])
        m = np.array([MONTH_OF[v[at["b"]].rstrip(".").lower()] for v in tokens]) if "b" in at else _ints(tokens, at["m"])
    timed = "h" in at or "hms" in at or "ymdhms" in at
    if "h" in at:
        h, mi = _ints(tokens, at["h"]), _ints(tokens, at["mi"])
        s = _ints(tokens, at["s"]) if "s" in at else zero
        if "p" in at:
            pm = np.array([v[at["p"]].lower().startswith("p") for v in tokens])
            ok &= (h >= 1) & (h <= 12)
            h = h % 12 + 12 * pm
    days, good = _days(y, m, d)
    ok &= good & (mi < 60) & (s < 60) & ((h < 24) | ((h == 24) & (mi == 0) & (s == 0)))
    local = days * 86400 + h * 3600 + mi * 60 + s
    if not timed:
        return days * 86400, ok
    for end in ("", "2"):
        if (k := "sign" + end) in at:
            if (p := at.get("ohm" + end)) is not None:
                minutes = _ints(tokens, p, 0, 2) * 60 + _ints(tokens, p, 2, 4)
            else:
                minutes = _ints(tokens, at["oh" + end]) * 60
                minutes = minutes + _ints(tokens, at["om" + end]) if "om" + end in at else minutes
            sign = np.array([-1 if v[at[k]] == "-" else 1 for v in tokens])
            return local - sign * minutes * 60, ok & (minutes <= 18 * 60)
    if "u" in at:
        return local, ok
    result = local.copy()
    if "abbr" in at:
        names = [v[at["abbr"]] for v in tokens]
        for i in range(n):
            table = transitions(zones[i]) if zones[i] else None
            off = table[2].get(names[i]) if table else None
            ok[i] &= off is not None
            result[i] -= off or 0
        return result, ok
    named = np.array([v[at["iana"]] for v in tokens], object) if "iana" in at else zones
    for zone in set(named):
        own = (named == zone) & ok
        if not zone:
            ok &= ~own
        elif own.any():
            result[own], ok[own] = local_to_utc(local[own], zone)
    return result, ok


def to_utc_seconds(values: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
    """Seconds since 1970 of each written value, null where it names no one instant."""
    by_mask: dict[str, list] = {}
    for i, v in enumerate(values):
        if v is not None and v == v and v.strip():
            mask, tokens, places = tokenise(v)
            if fields := parser_for(mask):
                by_mask.setdefault(mask, [fields, places, [], []])
                by_mask[mask][2].append(i)
                by_mask[mask][3].append(tokens)
    out, valid = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    z, o = zones.fillna("").to_numpy(object), orders.fillna("").to_numpy(object)
    for fields, places, rows, tokens in by_mask.values():
        r = np.array(rows)
        out[r], valid[r] = _convert(fields, tokens, places, z[r], o[r])
    return pd.Series(out).where(pd.Series(valid)).astype("Int64")


@F.pandas_udf(LongType())
def utc_seconds(value: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
    return to_utc_seconds(value, zone, order).set_axis(value.index)


def utc_instant(value: Column | str, zone: Column | str, order: Column | str) -> Column:
    """The instant of a written value as `yyyy-MM-ddTHH:mm:ssZ`, null where it names none.
    zone: the zone in which local times are read; order: dmy, mdy or ymd, for all-numeric dates."""
    at = F.timestamp_seconds(utc_seconds(value, zone, order))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalise_timestamps(rows: DataFrame, sites: DataFrame, key: str = "article_id", value: str = "date") -> DataFrame:
    """(key, utc): one row for each key whose value names exactly one instant; repeated rows count once.
    rows needs key, value and site_id, sites site_id, tz and date_order; other columns are ignored. Rows without a
    site are read without zone and order: a value that needs either gives no row."""
    places = sites.select("site_id", "tz", "date_order").dropDuplicates(["site_id"])
    stated = rows.select(F.col(key), "site_id", F.col(value).alias("_value")).where(F.col("_value").isNotNull())
    return (
        stated.join(places, "site_id", "left")
        .select(F.col(key), utc_instant("_value", "tz", "date_order").alias("utc", metadata={"zone_version": zone_version()}))
        .where(F.col("utc").isNotNull())
        .distinct()
    )
