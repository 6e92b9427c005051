import math

import pytest
from pyspark.sql import functions as F

from pagewright.functions import dates as D
from pagewright.functions import text as T


def one(spark, expression, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, value, expected",
    [
        (T.normalize_whitespace, "hello\t\nworld  ", "hello world"),
        (T.normalize_whitespace, "hello\tworld", "hello\tworld"),
        (T.strip_control_chars, "Hello\t\n\r\fWorld\x00\x1f", "Hello\t\n\r\fWorld"),
        (T.normalize_text, "\x00Hello\x01 \x02World\x03\n ", "Hello World"),
        (T.normalize_unicode, "é hello world “x” —", 'é hello world "x" --'),
        (T.tighten_tags, "Hello < p >World< /p >", "Hello<p>World</p>"),
        (T.unescape_basic, "&amp;lt; &lt;b&gt;", "&lt; <b>"),
        (T.decode_entities, "&eacute;&unknown;&copy;", "é&unknown;©"),
        (T.count_words, "This, is a sentence. With punctuation!", 6),
        (T.count_words, "", 0),
        (T.count_sentences, "Dr. Smith went to the store. He bought some apples.", 2),
        (T.count_sentences, "no end", 1),
        (T.count_sentences, "", 0),
        (T.char_count, "a,b,,c", 3),
        (T.is_important_link, "Read more", True),
        (T.is_important_link, "about us", False),
        (T.is_valid_byline, "Jane Doe", True),
        (T.is_valid_byline, "12345/67", False),
        (T.reading_level, "", 0.0),
        (T.reading_time, "a b c", 1),
        (T.content_digest, "Hello", "185f8db32271fe25f561a6fc938b2e264306ec304eda518007d1764826381969"),
        (T.content_digest, "", ""),
        (T.is_control_category, "؜", True),
        (T.is_control_category, "a", False),
    ],
)
def test_functions(spark, function, value, expected):
    assert one(spark, function("v"), v=value) == expected
    assert one(spark, function("v"), v=None) in (None, 0.0, 1, 0, -1)


@pytest.mark.parametrize("word, n", [("cat", 1), ("hello", 2), ("beautiful", 3), ("make", 1), ("rhythm", 2), ("read", 1), ("happy", 2)])
def test_syllables(spark, word, n):
    assert one(spark, T.count_syllables("v"), v=word) == n


def test_reading_level(spark):
    simple = one(spark, T.reading_level("v"), v="The cat sat on the mat. It was a big cat.")
    hard = one(spark, T.reading_level("v"), v="Extraordinarily sophisticated methodologies necessitate comprehensive interdisciplinary collaboration among institutional representatives.")
    assert simple < 3 < 15 < hard


def test_similarity(spark):
    f = T.text_similarity("a", "b")
    assert one(spark, f, a="Same", b="same") == 1.0
    assert one(spark, f, a="", b="x") == 0.0
    assert math.isclose(one(spark, f, a="a b c", b="b c d"), 2 / 4)


@pytest.mark.parametrize(
    "function, value, expected",
    [
        (D.parse_iso, "2023-03-27T15:04:05+02:00", "2023-03-27 13:04:05"),
        (D.parse_iso, "2023-03-27T15:04:05.123Z", "2023-03-27 15:04:05"),
        (D.parse_iso, "Mon, 27 Mar 2023 15:04:05 GMT", "2023-03-27 15:04:05"),
        (D.parse_iso, "not a date", None),
        (D.parse_regional, "03/27/2023", "2023-03-27 00:00:00"),
        (D.parse_regional, "27/03/2023", "2023-03-27 00:00:00"),
        (D.parse_regional, "03/27/23", "2023-03-27 00:00:00"),
        (D.parse_regional, "2023/03/27", "2023-03-27 00:00:00"),
        (D.parse_regional, "03/27/2023 15:04:05", "2023-03-27 15:04:05"),
        (D.parse_natural, "March 27 2023", "2023-03-27 00:00:00"),
        (D.parse_natural, "27th March 2023", "2023-03-27 00:00:00"),
        (D.parse_natural, "2023 March 27", "2023-03-27 00:00:00"),
        (D.parse_natural, "March 27, 23", "2023-03-27 00:00:00"),
        (D.parse_components, "20230327", "2023-03-27 00:00:00"),
        (D.parse_components, "2023-03", "2023-03-01 00:00:00"),
        (D.parse_components, "Published in 2023", "2023-01-01 00:00:00"),
        (D.cleanup_date, "Published on date: March 27, 2023", "March 27, 2023"),
        (D.cleanup_date, "<span>Posted on March 27, 2023</span>", "March 27, 2023"),
    ],
)
def test_dates(spark, function, value, expected):
    assert one(spark, function("v").cast("string"), v=value) == expected


def test_relative_dates(spark):
    at = F.lit("2024-01-10 12:00:00").cast("timestamp")
    for text, expected in (("2 days ago", "2024-01-08 12:00:00"), ("yesterday", "2024-01-09 12:00:00"), ("3 hrs ago", "2024-01-10 09:00:00"), ("soon", None)):
        assert one(spark, D.parse_relative("v", at).cast("string"), v=text) == expected
