from collections import Counter

import numpy as np
import pytest

from pagewright.llm import languages, quality
from pagewright.llm.alphabet import bounded


@pytest.fixture(scope="module")
def scorer(sentences):
    samples = [(k, s) for k, v in sentences.items() for s in v]
    words = [(k, w.strip(".,"), 10) for k, v in sentences.items() for w in " ".join(v).split()]
    return languages.Scorer(languages.fit_profiles(samples, words))


def counts(scorer, text):
    ((mean, numbers, _),) = scorer.documents([text])
    lang, _ = scorer.decide(mean, numbers)
    return {scorer.langs[j]: int((lang == j).sum()) for j in set(lang.tolist()) if j >= 0}


def test_held_out_lines(scorer):
    lines = {
        "en": "the old people of the town never knew that the church was open in the spring",
        "de": "die alten Leute der Stadt wissen nie, dass die Kirche im Frühling auf ist",
        "fr": "les gens de la ville ne sont jamais venus à la vieille église au printemps",
        "es": "la gente de la ciudad nunca vino a la vieja iglesia en primavera",
        "ru": "люди города никогда не пришли в старую церковь весной",
    }
    for lang, line in lines.items():
        assert counts(scorer, line) == {lang: 1}


def test_mixed_and_interleaved(scorer, sentences):
    de, en = sentences["de"] * 3, sentences["en"] * 2
    assert counts(scorer, "\n".join([*de, *en])) == {"de": 9, "en": 6}
    mixed = [x for p in zip(de, [*en, *de[:3]]) for x in p]
    assert counts(scorer, "\n".join(mixed))["en"] == 6
    assert counts(scorer, "\n".join(s.upper() for s in de)) == {"de": 9}


def test_slices_change_nothing(scorer, sentences, monkeypatch):
    text = "\n".join([*sentences["de"], "", *sentences["en"]])
    want = scorer.documents([text, "", text])
    monkeypatch.setattr(languages, "SLICE", 37)
    for size in (37, 90, 1):
        monkeypatch.setattr(languages, "SLICE", size)
        for one, other in zip(want, scorer.documents([text, "", text]), strict=True):
            assert all(a.shape == b.shape and np.allclose(a, b, atol=1e-5) for a, b in zip(one, other))


def test_distance_is_that_of_two_orders(scorer, monkeypatch):
    def brute(text):
        c = np.concatenate([[0], languages.classes_of(text), [0, 0]]).astype(np.uint8)
        held = Counter(x for x in languages._grams(c).ravel().tolist() if x >= 0)
        place = {g: sum(n > k for n in held.values()) for g, k in held.items()}
        return [np.mean([abs(languages._log_place(place[g]) - scorer.places[g, j]) for g in held]) for j in range(len(scorer.langs))]

    for text in ("the old man and the sea and the the the river", "een", "Straße und Brücke und Fluss", "aaaa"):
        ((_, _, own),) = scorer.documents([text])
        assert np.allclose(own, brute(text), atol=1e-5)
    # other frequencies of the same n-grams are another order, so another distance
    a, b = "the the the the xyq", "the xyq xyq xyq xyq"
    assert not np.allclose(scorer.documents([a])[0][2], scorer.documents([b])[0][2], atol=1e-4)
    unit, counts = np.repeat([0, 1, 3], [3, 2, 4]), np.array([5, 1, 5, 2, 2, 1, 9, 3, 3])
    want = [sum(o > c for v, o in zip(unit, counts) if v == u) for u, c in zip(unit, counts)]
    assert languages._shared_places(unit, counts, 4).tolist() == want
    monkeypatch.setattr(languages, "LEAST_TABLE", 0)
    big = counts * 10**6
    assert languages._shared_places(unit, big, 4).tolist() == want


def test_stretches_of_least_distance():
    import itertools

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 6):
        e = rng.random((n, 3))
        cost = lambda p, e=e: sum(e[i, k] for i, k in enumerate(p)) + 0.3 * sum(p[i] != p[i - 1] and (i < 2 or p[i] != p[i - 2]) for i in range(1, len(p)))
        path = languages._least_path(e, 0.3).tolist()
        assert abs(cost(path) - min(map(cost, itertools.product(range(3), repeat=n)))) < 1e-9


def test_sample_is_bounded_by_language(spark):
    rows = [(k, f"text {i}") for k in ("a", "b", "z") for i in range(30)]
    got = bounded(spark.createDataFrame(rows, "lang string, text string"), "text", 10)
    assert [sum(k == x for x, _ in got) for k in "abz"] == [10] * 3 and got == sorted(got)


def test_language_tables(spark, samples, lexicon, sentences):
    profiles = languages.profiles_of(samples, lexicon)
    de, en = "\n".join(sentences["de"] * 3), "\n".join(sentences["en"] * 2)
    rows = [(1, de, "de"), (2, de, "en_US"), (3, f"{de}\n{en}", "GER"), (4, None, None), (5, "", "en"), (6, "12 34", None), (7, de, None), (7, de, None), (8, de, "unknown")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, language string")
    got = {tuple(r) for r in languages.unlabelled_languages(docs, profiles).collect()}
    assert got == {(2, "de"), (3, "en"), (7, "de"), (8, "de")}
    whole = {r["doc_id"]: r for r in languages.document_languages(docs, profiles).collect()}
    assert whole[3]["language"] == "de" and len(whole[3]["segments"]) == 2 and whole[4]["language"] is None and whole[4]["segments"] == []
    assert languages.unlabelled_languages(docs.limit(0), profiles).count() == 0


def test_measures():
    common = frozenset(("the", "a"))
    m = dict(zip(quality.STATISTICS, quality.measure("The cat saw a dog. It ran!", common)))
    assert m["words"] == 7 and m["end_punctuation"] == 1 and abs(m["common_share"] - 2 / 7) < 1e-9 and m["digit_ratio"] == 0
    lines = dict(zip(quality.STATISTICS, quality.measure("A line ends here.\nanother one does not\n\nDoes this one?\nno", common)))
    assert lines["end_punctuation"] == 0.5
    assert quality.measure(None, common) == quality.measure("", common) == (0.0,) * len(quality.STATISTICS)


def test_kinds(sentences):
    rows = [(k, s) for k, v in sentences.items() for s in v]
    common = frozenset(w.strip(".,").lower() for _, s in rows for w in s.split() if len(w) < 5)
    prose = [f"{a} {b}" for v in sentences.values() for a in v for b in v if a != b] * 8
    junk = ["- " * 80, "zxcv qwrt " * 20, "x1y2Z3" * 40, "name 12 34 5:6 " * 12, "1. Ann Lee Town 2:32,3 2. Bob Ray City 3:43,4 " * 4]
    x = np.array([quality.measure(t, common)[1:] for t in prose + junk])
    m, ex, labels, kinds = quality.start(rows, common, x.mean(0), np.maximum(x.std(0), 0.02))
    for _ in range(quality.ROUNDS):
        m = m.updated(m.sums(x), ex, labels)
    m = quality.mapped(m, ex, kinds)
    best = m.kind_chances(x).argmax(axis=1)
    assert (best[: len(prose)] == 0).all() and (best[len(prose) :] != 0).all()
    known = m.kind_chances(ex).argmax(axis=1)
    assert np.mean([quality.KINDS[b] == k for b, k in zip(known, kinds)]) > 0.9


def test_quality_table(spark, articles, samples, lexicon, sentences):
    text = " ".join(sentences["en"])
    rows = [{"article_id": i, "plain_text": [text, "- " * 90, "short", None]} for i in range(30)]
    rows += [{"article_id": 0, "plain_text": [text, "- " * 90, "short", None]}, {"article_id": 50}, {"article_id": 51, "plain_text": [""]}]
    got = sorted(tuple(r) for r in quality.other_than_prose(articles(rows), samples, lexicon).collect())
    assert got == [(i, 1) for i in range(30)]
    assert quality.other_than_prose(articles(rows[:1]).limit(0), samples, lexicon).count() == 0


def test_statistics_of_every_text(spark, articles, samples, lexicon, sentences):
    text = " ".join(sentences["en"])
    plain = f"<div>\n<p>{text}</p>\n<pre>{'a = b; ' * 30}</pre>\n<p>Tom &amp; Ann</p>\n</div>"
    rows = [{"article_id": i, "content": "<p>x</p>", "plain_content": plain, "plain_text": [text, "a = b; " * 30, "Tom & Ann"]} for i in range(20)]
    rows += [{"article_id": 50}, {"article_id": 51, "content": "<p>undefined</p>", "plain_content": "<div><p>one two</p></div>", "plain_text": ["one two"]}, {"article_id": 52, "plain_content": "", "plain_text": [None, ""]}]
    got = {(r["article_id"], r["field"], r["block_no"]): r for r in quality.text_kinds(articles(rows), samples, lexicon).collect()}
    assert len(got) == 20 * 4 + 1 + 2 + 3
    assert got[0, "plain_content", None]["words"] == got[0, "plain_text", 0]["words"] + got[0, "plain_text", 1]["words"] + 2
    assert got[0, "plain_text", 0]["kind"] == "prose" and [got[0, "plain_text", i]["kind"] for i in (1, 2)] == [None] * 2
    assert got[51, "plain_text", 0]["words"] == got[51, "plain_content", None]["words"] == 2 and got[51, "plain_text", 0]["kind"] is None
    for key in ((52, "plain_text", 0), (52, "plain_text", 1), (50, "plain_content", None), (52, "plain_content", None)):
        assert all(got[key][s] == 0 for s in quality.STATISTICS)
    assert quality.text_kinds(articles(rows).limit(0), samples, lexicon).count() == 0


def test_common_words_of_a_lexicon_of_any_size(spark, articles, samples, lexicon, sentences, monkeypatch):
    many = spark.range(10_500).selectExpr("'en' AS lang", "concat('Word', id) AS word")
    assert quality.common_words(many) == {f"word{i}" for i in range(10_500)}
    text = " ".join(sentences["en"])
    plain = f"<div>\n<p>{text}</p>\n<p>Tom &amp; Ann</p>\n</div>"
    rows = [{"article_id": i, "content": "<p>x</p>", "plain_content": plain, "plain_text": [text, "- " * 90, sentences["ru"][i % 3], None]} for i in range(20)]
    rows += [rows[0], {"article_id": 50}, {"article_id": 51, "plain_text": [""]}]

    def told():
        found = quality.text_kinds(articles(rows), samples, lexicon).collect()
        return sorted((r["article_id"], r["field"], -1 if r["block_no"] is None else r["block_no"], r["kind"] or "", *(r[s] for s in quality.STATISTICS)) for r in found)

    held = told()
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 3)
    assert not isinstance(quality.common_words(lexicon), frozenset)
    assert told() == held and len(held) == 21 * 5 + 1 + 2 and any(r[4 + quality.STATISTICS.index("common_share")] > 0.9 for r in held)
    assert quality.text_kinds(articles(rows).limit(0), samples, lexicon).count() == 0
