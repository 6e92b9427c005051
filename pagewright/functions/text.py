"""Text functions as column expressions. All but compatibility composition and the table of entities stay in the JVM.

Lengths are in bytes of UTF-8, as the thresholds mean. Null gives null throughout.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions import rules

Text = Column | str


def _c(value: Text) -> Column:
    return F.col(value) if isinstance(value, str) else value


# Whitespace and characters ------------------------------------------------------------------------------------------
def normalize_whitespace(value: Text) -> Column:
    """Runs of white space to one blank and none at the ends; a text without two blanks in a row and blanks at its ends stays as it is."""
    t = _c(value)
    odd = t.contains("  ") | t.startswith(" ") | t.rlike(r"\s$")
    return F.when(odd, F.trim(F.regexp_replace(t, r"\s+", " "))).otherwise(t)


def collapse_whitespace(value: Text) -> Column:
    """Runs of white space to one blank and none at the ends."""
    return F.trim(F.regexp_replace(_c(value), r"\s+", " "))


def get_normalized(value: Text) -> Column:
    """Runs of two or more white space characters to one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(value), r"\s{2,}", " "))


def strip_control_chars(value: Text) -> Column:
    """Without characters that are neither printable nor a line break, tab or form feed."""
    return F.regexp_replace(_c(value), r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\t\r\f]", "")


def is_control_category(value: Text) -> Column:
    """Whether a character is a control, format, private use, surrogate or unassigned one."""
    return _c(value).rlike(r"^[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}]$")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v.isascii() else unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(value: Text) -> Column:
    """Compatibility composition, which Spark has no expression for."""
    return _nfkc(_c(value))


def replace_signs(value: Text) -> Column:
    """Typographic signs to their plain writing."""
    t = _c(value)
    single = {k: v for k, v in rules.REPLACEMENTS.items() if len(v) == 1}
    t = F.translate(t, "".join(single), "".join(single.values()))
    for k, v in rules.REPLACEMENTS.items():
        if k not in single:
            t = F.replace(t, F.lit(k), F.lit(v))
    return t


def normalize_unicode(value: Text) -> Column:
    return replace_signs(nfkc(value))


def normalize_text(value: Text) -> Column:
    """Unicode, then control characters, then white space."""
    return normalize_whitespace(strip_control_chars(normalize_unicode(value)))


def tighten_tags(value: Text) -> Column:
    """Markup without blanks before tags and inside their angles."""
    return F.regexp_replace(_c(value), r"\s*<\s*(/?[a-zA-Z][^>]*?)\s*>", "<$1>")


def strip_html_whitespace(value: Text) -> Column:
    return tighten_tags(normalize_text(value))


def unescape_basic(value: Text) -> Column:
    """The five basic entities; &amp; last, so that nothing is decoded twice."""
    t = _c(value)
    for name, sign in rules.BASIC_ENTITIES.items():
        t = F.replace(t, F.lit(f"&{name};"), F.lit(sign))
    return t


@F.pandas_udf(StringType())
def _entities(values: pd.Series) -> pd.Series:
    pattern = re.compile("&([a-z]+[0-9]*);")
    return values.map(lambda v: pattern.sub(lambda m: rules.ENTITIES.get(m[1], m[0]), v) if "&" in v else v, na_action="ignore")


def decode_entities(value: Text) -> Column:
    """The listed named entities in one pass; others stay."""
    return _entities(_c(value))


# Counts and grades --------------------------------------------------------------------------------------------------
def byte_length(value: Text) -> Column:
    return F.octet_length(_c(value))


def char_count(value: Text, sign: str = ",") -> Column:
    """How often a sign stands in a text."""
    t = _c(value)
    return ((F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))) / len(sign)).cast("int")


def words(value: Text) -> Column:
    """The words between white space."""
    return F.array_remove(F.split(F.regexp_replace(_c(value), r"\s+", " "), " "), "")


def count_words(value: Text) -> Column:
    return F.size(words(value))


def count_sentences(value: Text) -> Column:
    """Runs from a letter or number to the next full stop, exclamation or question mark, or the end; full stops of titles don't count."""
    t = _c(value)
    for a in rules.ABBREVIATIONS:
        t = F.replace(t, F.lit(a), F.lit(a.replace(".", "")))
    return F.size(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}][^.!?]*([.!?]|$)"), F.lit(0)))


def word_syllables(word: Column) -> Column:
    """Groups of vowels, without a silent e at the end, at least one."""
    w = F.lower(word)
    groups = F.greatest(F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0))), F.lit(1))
    silent = (F.octet_length(w) > 2) & w.rlike("[^aeiouy]e$")
    return F.when(w == "rhythm", 2).otherwise(F.greatest(groups - silent.cast("int"), F.lit(1)))


def count_syllables(value: Text) -> Column:
    """Syllables of all words, by patterns over the whole text: groups of vowels, each word without one counting for one, without the
    silent ends of words that have another, and one more for each rhythm."""
    t = F.lower(F.concat(F.lit(" "), F.regexp_replace(_c(value), r"\s+", " "), F.lit(" ")))
    groups = F.regexp_count(t, F.lit("[aeiouy]+"))
    bare = F.regexp_count(t, F.lit("(?<= )[^ aeiouy]++(?= )"))
    silent = F.regexp_count(t, F.lit("[^ aeiouy]e(?= )")) - F.regexp_count(t, F.lit("(?<= )[^ aeiouy]++e(?= )"))
    rhythm = F.regexp_count(t, F.lit("(?<= )rhythm(?= )"))
    return groups + bare - silent + rhythm


def reading_level(value: Text) -> Column:
    """Flesch-Kincaid grade; 0 without words or sentences. Each count is worked out once."""
    counts = F.array(F.struct(count_words(value).alias("w"), count_sentences(value).alias("s"), count_syllables(value).alias("y"), _c(value).alias("t")))
    grade = lambda x: F.when((x["w"] == 0) | (x["s"] == 0) | (x["t"] == "no sentences"), 0.0).otherwise(0.39 * (x["w"] / x["s"]) + 11.8 * (x["y"] / x["w"]) - 15.59)
    return F.when(_c(value).isNotNull(), F.transform(counts, grade)[0])


def reading_time(value: Text) -> Column:
    """Minutes at 225 words each, at least one."""
    return F.greatest(F.floor(count_words(value) / rules.WORDS_A_MINUTE), F.lit(1)).cast("int")


def text_similarity(a: Text, b: Text) -> Column:
    """Tokens of a that b has, over all tokens less those; 1 for equal texts, 0 if either is empty."""
    x, y = F.lower(_c(a)), F.lower(_c(b))
    tokens = lambda c: F.filter(F.split(c, r"[^0-9A-Za-z_]+"), lambda t: t != "")
    ta, tb = tokens(x), tokens(y)
    shared = F.size(F.filter(ta, lambda t: F.array_contains(tb, t)))
    return (
        F.when(x == y, 1.0)
        .when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0)
        .otherwise(shared / (F.size(ta) + F.size(tb) - shared))
    )


def content_score(value: Text) -> Column:
    """The score of a paragraph: 1, its commas, and up to 3 for its length."""
    return 1.0 + char_count(value) + F.least(byte_length(value) / rules.LENGTH_DIVISOR, F.lit(rules.MAX_LENGTH_BONUS))


def class_weight(class_name: Text, identifier: Text) -> Column:
    """25 for a promising class and as much for a promising identifier, minus 25 for either of the contrary."""
    one = lambda c: (
        F.when(c.rlike(rules.POSITIVE), rules.CLASS_WEIGHT).otherwise(0) - F.when(c.rlike(rules.NEGATIVE), rules.CLASS_WEIGHT).otherwise(0)
    )
    return one(F.coalesce(_c(class_name), F.lit(""))) + one(F.coalesce(_c(identifier), F.lit("")))


def is_unlikely(class_name: Text, identifier: Text) -> Column:
    both = F.concat(F.coalesce(_c(class_name), F.lit("")), F.lit(" "), F.coalesce(_c(identifier), F.lit("")))
    return both.rlike(rules.UNLIKELY) & ~both.rlike(rules.MAYBE)


def is_important_link(value: Text) -> Column:
    """Whether a link's text promises more of the article."""
    t = F.lower(_c(value))
    return (
        t.rlike("|".join(rules.IMPORTANT_LINKS))
        | (t.contains("...") & (F.octet_length(t) < 30))
        | (t == "more")
        | t.endswith(" more")
    )


def is_valid_byline(value: Text) -> Column:
    """1 to 100 bytes; with a separating sign, digits are no more than three tenths of the bytes."""
    t = F.trim(_c(value))
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return F.octet_length(t).between(1, 100) & (~t.rlike("[/•·|—-]") | (digits <= 0.3 * F.octet_length(t)))


def has_word(value: Text, listed: tuple[str, ...]) -> Column:
    return F.lower(_c(value)).rlike("|".join(re.escape(w) for w in listed))


def clean_title(value: Text) -> Column:
    """A title without a short first or last part, by the first separator that sets one apart."""
    t = get_normalized(value)
    out = t
    for sep in reversed((" | ", " - ", " :: ", " / ", " » ")):
        parts = F.split(t, "[|]".join(sep.split("|")))
        n = F.size(parts)
        last, first = F.octet_length(F.element_at(parts, -1)) < 10, F.octet_length(F.element_at(parts, 1)) < 10
        own = F.when(last, F.array_join(F.slice(parts, F.lit(1), n - 1), sep)).when(first, F.array_join(F.slice(parts, F.lit(2), n - 1), sep))
        out = F.when((n > 1) & (last | first), F.trim(own)).otherwise(out)
    return out


def is_error_page(title: Text, body: Text) -> Column:
    t, b = F.lower(_c(title)), F.lower(_c(body))
    return t.contains("not found") | t.contains("error page") | b.contains("page not found") | b.contains("404 error") | b.contains("error 404")


# Digests ------------------------------------------------------------------------------------------------------------
def content_digest(value: Text) -> Column:
    """The SHA-256 digest of a normalised text, empty for an empty one."""
    t = normalize_text(value)
    return F.when(t == "", "").otherwise(F.sha2(t, 256))


def string_digest(value: Text) -> Column:
    return F.md5(_c(value))


def content_type_name(code: Text) -> Column:
    names = F.array(*[F.lit(n) for n in rules.CONTENT_TYPES])
    return F.coalesce(F.get(names, _c(code)), F.lit("Unknown"))
