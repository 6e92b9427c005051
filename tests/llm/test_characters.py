import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import garbled, lookalikes
from pagewright.llm.lookalikes import consistent, differs


@pytest.mark.parametrize(
    "value, expected",
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"),
        ("café", "café"),
        ("ậ", "ậ"),
        ("no break thin", "no break thin"),
        ("in​vi­si⁠ble﻿", "invisible"),
        ("Thе mауоr", "The mayor"),
        ("Нора Кемгуpeнко", "Нора Кемгуренко"),
        ("Hopa Keмгypeнкo", "Нора Кемгуренко"),
        ("ɡreɑt օrɡaո", "great organ"),
        ("𝗍𝗋𝖺𝗆 𝚃𝚒𝚖𝚎", "tram Time"),
        ("ﬆation ﬁnal", "station final"),
        ("Zimsur‑ley", "Zimsur-ley"),
    ],
)
def test_cases(value, expected):
    assert consistent(value) == expected and differs(value) and not differs(expected)


@pytest.mark.parametrize(
    "value",
    ["plain", "", None, "“quotes” – dashes — …", "Ωμέγα in a text", "αβγ.", "Молмарово in a text", "Grade C# was sung в городе", "👩‍🚀 👨‍🌾", "é ü ß ё й", "trailing  ", "а и о в тексте", "№ 5 ™ ½", "x² ª º", "a\tb\nc"],
)
def test_not_cases(value):
    assert consistent(value) == value and not differs(value)


@given(st.text(max_size=50))
@settings(max_examples=500, deadline=None)
def test_the_form_is_stable(text):
    once = consistent(text)
    assert consistent(once) == once


def test_conflicts_are_refused():
    with pytest.raises(ValueError):
        lookalikes.Transducer([("a", "b"), ("a", "c")])
    with pytest.raises(ValueError):
        lookalikes.Transducer([("a", "b"), ("b", "c")])
    with pytest.raises(ValueError):
        lookalikes.Transducer([], [("a\u0301", "á"), ("a\u0301", "à")])
    with pytest.raises(ValueError):
        lookalikes.Transducer([("á", "a")], [("a\u0301", "á")])
    joined = [("a\u0323", "ạ"), ("a\u0323\u0302", "ậ")]
    assert lookalikes.Transducer([("ａ", "a")], joined)("ａ\u0302\u0323 a\u0302 a\u0323") == "ậ a\u0302 ạ"


@given(st.text(st.sampled_from("aeioustzнйυ\u0301\u0302\u0308\u0323\u0328\u0306\u0331\u1112\u1161\u11ab가"), max_size=12))
@settings(max_examples=500, deadline=None)
def test_equal_clusters_become_equal(text):
    assert consistent(unicodedata.normalize("NFD", text)) == consistent(text) == consistent(unicodedata.normalize("NFC", text))


@pytest.mark.parametrize("value, expected", [("a\u0302\u0323", "ậ"), ("o\u0301\u0328", "o\u0328\u0301"), ("\u1112\u1161\u11ab", "한"), ("\u2126 \u212b", "Ω Å"), ("ｶﾞｷ", "ガキ"), ("e\u200b\u0301", "é"), ("1\ufe0f\u20e3", "1\ufe0f\u20e3")])
def test_clusters(value, expected):
    assert consistent(value) == unicodedata.normalize("NFC", expected)


@pytest.fixture(scope="module")
def restorer(sentences):
    return garbled.Restorer({k: "\n".join(v) for k, v in sentences.items()})


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("cp1252", "mac-roman"), ("cp1252", "cp437")]


@pytest.mark.parametrize("written, read", CHAINS)
@pytest.mark.parametrize("lang", ["de", "fr", "es"])
def test_round_trips(restorer, sentences, written, read, lang):
    for s in sentences[lang]:
        try:
            bad = "".join(garbled._decoded(read)[b] for b in s.encode(written))
        except UnicodeEncodeError:
            continue
        if bad != s:
            assert restorer.restore(bad)[0] == s, (bad, written, read)


@pytest.mark.parametrize("written, read", [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp1252"), ("koi8-r", "latin-1"), ("cp1251", "cp866")])
def test_russian_round_trips(restorer, sentences, written, read):
    for s in sentences["ru"]:
        bad = "".join(garbled._decoded(read)[b] for b in s.encode(written))
        assert restorer.restore(bad)[0] == s


def test_twice_and_in_part(restorer):
    good = "Zuerst lobte die Witwe naïve Gärtner über den Fluss."
    twice = good.encode().decode("latin-1").encode().decode("latin-1")
    assert restorer.restore(twice)[0] == good
    assert restorer.restore("Der Richter lobte â€œnaÃ¯veâ€\x9d Leute über dem Fluss.")[0] == "Der Richter lobte “naïve” Leute über dem Fluss."


def test_right_texts_stay(restorer, sentences):
    for v in sentences.values():
        for s in v:
            assert restorer.restore(s) == (s, "") and restorer.restore(s.upper()) == (s.upper(), "")
    for s in (None, "", "NÃO", "Moscow Товтовово", "«цитата» — сказал", "Thе mауоr ɡreat", " x"):
        assert restorer.restore(s)[1] == ""
    assert restorer.restore("na�ve") == ("na�ve", "lost")


def test_tables(spark, articles, samples, lexicon):
    rows = [
        {"article_id": 1, "title": "naÃ¯ve idea", "byline": "Ａｎｎ", "plain_text": ["plain", "ｗｉｄｅ words", None, "", "x" * 30000]},
        {"article_id": 1, "title": "naÃ¯ve idea", "byline": "Ａｎｎ", "plain_text": ["plain", "ｗｉｄｅ words", None, "", "x" * 30000]},
        {"article_id": 2},
        {"article_id": 3, "title": "", "plain_text": []},
    ]
    a, d = articles(rows), garbled.dictionaries_of(samples, lexicon)
    got = garbled.restored_values(a, d).collect()
    assert [(r["article_id"], r["field"], r["block_no"], r["restored"]) for r in got] == [(1, "title", -1, "naïve idea")]
    found = {tuple(r)[:3] for r in lookalikes.differing_values(a, d).collect()}
    assert found == {(1, "byline", -1), (1, "text", 1)}
    forms = {r["article_id"]: r for r in lookalikes.consistent_articles(a).collect()}
    assert forms[1]["byline"] == "Ann" and forms[1]["blocks"][1] == "wide words" and forms[1]["blocks"][2] is None and forms[2]["title"] is None
    assert garbled.restored_values(a.limit(0), d).count() == lookalikes.differing_values(a.limit(0), d).count() == 0


def test_batches_without_a_case(spark, articles, samples, lexicon):
    rows = [{"article_id": i, "title": "Café", "byline": "Zoë", "plain_text": ["déjà"]} for i in range(5)]
    dictionaries = garbled.dictionaries_of(samples, lexicon)
    assert lookalikes.differing_values(articles(rows), dictionaries).count() == 0
    assert garbled.restored_values(articles(rows), dictionaries).count() == 0
