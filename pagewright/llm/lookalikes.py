"""One consistent form for text that looks the same but is written with different characters.

A transducer over grapheme clusters maps, in one pass and by longest match, full-width, half-width and styled forms to
plain ones, accents in canonical order to their letters, syllables of Hangul to one sign, blanks to the plain blank, and unseen characters to nothing. Its table is
worked out once from the character database and a list of look-alike letters, and refused if two rules disagree or
if a result would change again. Look-alike letters depend on the word: letters of a word of mixed scripts go to the
script that most of it is written in, or the text if the word doesn't tell; a word really written in another
script stays.

Defined results: null stays null, empty text stays empty; usual quotes, dashes and other typographic signs, joiners
within pictures and trailing plain blanks stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagewright.llm.alphabet import PICTURES
from pagewright.llm.garbled import restorer, values_of

#: Letters of other scripts that look like Latin ones, by script.
LIKE_LATIN = {
    "cyrillic": "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY ҮY ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ӏl ԁd ԛq ԝw ԍg ѵv ҽe ɡg",
    "greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp αa ιi κk τt υu χx ϲc ϳj",
    "armenian": "օo ոn սu հh ցg ոn զq յj ԼL ՕO ՍU ՏS",
    "latin": "ɑa ɡg ɩi",
}
#: Latin letters that look like Cyrillic ones.
LIKE_CYRILLIC = "AА BВ CС EЕ HН KК MМ OО PР TТ XХ YУ aа cс eе oо pр xх yу ëё ËЁ"
#: Hyphens that look like the plain one.
HYPHENS = "‐‑﹣－"
#: Characters that only shape or join others and can't be seen.
UNSEEN = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff]"
)
BLANKS = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Combining marks by class, of the basic plane.
_CLASS = {chr(o): unicodedata.combining(chr(o)) for o in range(0x300, 0x10000) if unicodedata.combining(chr(o))}
_MARK = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\ufe20-\ufe2f"
#: Joiners, picture selectors and tags within or after pictures and digits in frames.
_PICTURE_JOIN = re.compile(f"(?<=[{PICTURES}\ufe0f\U0001f3fb-\U0001f3ff])(?:\u200d(?=[{PICTURES}])|\ufe0f)|\ufe0f(?=\u20e3)")
_HELD = {"\u200d": "\ue000", "\ufe0f": "\ue001"}
_FLAG, _FLAG_HELD = re.compile("\U0001f3f4[\U000e0020-\U000e007f]+"), {o: chr(0xE100 + o - 0xE0020) for o in range(0xE0020, 0xE0080)}
_RELEASED = {ord(v): k for k, v in _HELD.items()} | {ord(v): chr(k) for k, v in _FLAG_HELD.items()}
_JOINERS = re.compile("[\u200d\ufe0f\U000e0020-\U000e007f]")
#: Words, with unseen characters inside.
_WORD = re.compile(f"(?:[^\\W\\d_][{_MARK}]*)+")
_FORMS = ("<wide>", "<narrow>", "<font>", "<compat>", "<circle>", "<square>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")
_WIDTHS = ("<wide>", "<narrow>")
#: Typographic signs that stay although a plainer writing is known.
_KEPT = frozenset("…‥№™℠℡℃℉‼⁇⁈⁉″‴‵‶₨℀℁℅℆ªº²³¹¼½¾µ´¨¸¯ſŉĿŀĳĲǆǅǄǉǈǇǌǋǊǳǲǱ")


def script_of(c: str) -> str | None:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x530 <= o < 0x590:
        return "armenian"
    if 0x250 <= o < 0x2B0:
        return "latin"
    return None


@lru_cache(1)
def likenesses() -> dict[str, dict[str, str]]:
    """For each script that a word may be written in, the foreign letters that look like its own."""
    latin = {p[0]: p[1] for v in LIKE_LATIN.values() for p in v.split()}
    return {"latin": latin, "cyrillic": {p[0]: p[1] for p in LIKE_CYRILLIC.split()}}


@lru_cache(1)
def forms() -> dict[str, str]:
    """Single characters of another width or form to plain ones, and doubles of the same character; found by rule in the character database."""
    out = {}
    for o in (*range(0x2070, 0x33FF), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0xFE50, 0xFE70), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F170)):
        c = chr(o)
        kind, *parts = unicodedata.decomposition(c).split(" ")
        if kind in _FORMS and c not in _KEPT and not UNSEEN.fullmatch(c):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and all(p.isalnum() or 33 <= ord(p) < 127 for p in plain) and not any(script_of(p) is None and p.isalpha() for p in plain):
                out[c] = plain
            elif kind in _WIDTHS and len(parts) == 1:
                out[c] = chr(int(parts[0], 16))
    out |= {c: "-" for c in HYPHENS}
    for o in (*range(0x340, 0xAC00), *range(0xF900, 0xFB50)):
        c = chr(o)
        if c not in out and c not in _CLASS and not BLANKS.fullmatch(c) and unicodedata.normalize("NFC", c) != c:
            out[c] = unicodedata.normalize("NFC", c)
    return out


#: Ranges beyond the basic plane that hold characters with a plain form.
_BEYOND = ((0x1D400, 0x1D7FF), (0x1F100, 0x1F16F), (0xE0000, 0xE0FFF))


class Transducer:
    """Maps the grapheme clusters of a text. rules: single characters and their results; joined: letters with their marks in canonical order, and the letter
    that they are. A trie over the marks of each letter finds the longest match, and passes over marks that it doesn't hold and that block no later one."""

    def __init__(self, rules: list[tuple[str, str]], joined: list[tuple[str, str]] = ()):
        self.single: dict[str, str] = {}
        self.apart: dict[str, str] = {}
        self.root: dict = {}
        for known, table in ((self.single, rules), (self.apart, [(v, k) for k, v in joined])):
            for key, value in table:
                if known.setdefault(key, value) != value:
                    raise ValueError(f"two results for {key!r}: {known[key]!r} and {value!r}")
        if both := self.single.keys() & self.apart.keys():
            raise ValueError(f"two results for {sorted(both)[0]!r}")
        seen: dict[str, str] = {}
        for key, value in joined:
            if seen.setdefault(key, value) != value:
                raise ValueError(f"two results for {key!r}: {seen[key]!r} and {value!r}")
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node[""] = value
        marks = "".join(map(re.escape, sorted({c for k in seen for c in k[1:]} | set(_CLASS) | {c for c, v in self.single.items() if v in _CLASS})))
        gone = "".join(map(re.escape, sorted(c for c, v in self.single.items() if not v)))
        between = f"[{gone}]*" if gone else ""
        singles = "|[" + "".join(map(re.escape, sorted(self.single))) + "]" if self.single else ""
        held = frozenset(self.single) | frozenset(marks.replace("\\", "")) | frozenset(map(chr, range(0x1100, 0x1200)))
        # one class that finds places quickly: characters beyond the basic plane only by a few ranges around them
        beyond = "".join(f"{chr(a)}-{chr(b)}" for a, b in _BEYOND if any(chr(a) <= c <= chr(b) for c in held))
        self.places = re.compile("[" + "".join(map(re.escape, sorted(c for c in held if c <= "\uffff"))) + beyond + "]+")
        self.clusters = re.compile(f"[^{marks}{gone}](?:{between}[{marks}])+|[\u1100-\u1112]{between}[\u1161-\u1175](?:{between}[\u11a8-\u11c2])?|[\uac00-\ud7a3]{between}[\u11a8-\u11c2]|[{marks}](?:{between}[{marks}])+{singles}")
        self.piece = lru_cache(65536)(lambda piece: self.clusters.sub(lambda m: self._cluster(m[0]), piece))
        for key, value in [*rules, *joined]:
            if self(value) != value:
                raise ValueError(f"the result {value!r} of {key!r} would change again")

    def _cluster(self, cluster: str) -> str:
        plain = "".join([self.apart.get(x, x) for c in cluster for x in self.single.get(c, c)])
        if len(plain) > 1 and "\u1100" <= plain[0] <= "\u1112" and "\u1161" <= plain[1] <= "\u1175":
            end = ord(plain[2]) - 0x11A7 if len(plain) > 2 else 0
            return chr(0xAC00 + ((ord(plain[0]) - 0x1100) * 21 + ord(plain[1]) - 0x1161) * 28 + end)
        if len(plain) > 1 and "\uac00" <= plain[0] <= "\ud7a3" and "\u11a8" <= plain[1] <= "\u11c2":
            return chr(ord(plain[0]) + ord(plain[1]) - 0x11A7) if not (ord(plain[0]) - 0xAC00) % 28 else plain
        i = next((i for i, c in enumerate(plain) if c not in _CLASS), len(plain))
        out = sorted(plain[:i], key=_CLASS.__getitem__)
        while i < len(plain):
            end = i + 1
            while end < len(plain) and plain[end] in _CLASS:
                end += 1
            marks = sorted(plain[i + 1 : end], key=_CLASS.__getitem__)
            node, letter, left = self.root.get(plain[i], {}), plain[i], []
            for m in marks:
                if m in node and not (left and _CLASS[left[-1]] == _CLASS[m]) and "" in node[m]:
                    node = node[m]
                    letter = node[""]
                else:
                    left.append(m)
            out += [letter, *left]
            i = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        out, at = [], 0
        for m in self.places.finditer(text):
            begin = m.start() - (m.start() > at)  # with the letter that marks may belong to
            out += [text[at:begin], self.piece(text[begin : m.end()])]
            at = m.end()
        return "".join([*out, text[at:]]) if out else text


@lru_cache(1)
def transducer() -> Transducer:
    rules = list(forms().items())
    rules += [(chr(o), " ") for o in range(0x80, 0x3001) if BLANKS.fullmatch(chr(o))]
    rules += [(chr(o), "") for o in (*range(0x80, 0x10000), *range(0xE0000, 0xE0200)) if UNSEEN.fullmatch(chr(o))]
    joined = []
    for o in (*range(0xC0, 0xAC00), *range(0xFB1D, 0xFB50)):
        apart = unicodedata.normalize("NFD", chr(o))
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == chr(o):
            joined.append((apart, chr(o)))
    return Transducer(rules, joined)


#: Letters of other scripts that may look like ones of the word's own.
_FOREIGN = re.compile("[\u0250-\u02af\u0370-\u058f]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")
_CYRILLIC = re.compile("[\u0400-\u052f]")
_FORMS_OF_LATIN = frozenset(p[0] for p in LIKE_LATIN["latin"].split())


@lru_cache(100_000)
def _script_of_word(word: str) -> tuple[str | None, bool]:
    """The script that the word's letters without a likeness tell, and whether all its letters belong to it or can be brought to it."""
    told = set()
    latin, cyrillic = likenesses()["latin"], likenesses()["cyrillic"]
    for c in word:
        if c.isalpha() and c not in latin and c not in cyrillic and (s := script_of(c)):
            told.add(s)
    return (told.pop() if len(told) == 1 else None), not told


def _words(text: str) -> str:
    """The text with look-alike letters brought to each word's script; a word that doesn't tell goes with the words around it if these agree."""
    found = list(_WORD.finditer(text))
    scripts = [_script_of_word(m[0]) for m in found]
    told = [s for s, _ in scripts]
    before, after, last = [], [], None
    for s in told:
        before.append(last)
        last = s or last
    last = None
    for s in reversed(told):
        after.append(last)
        last = s or last
    after.reverse()
    mixed = any(s == "cyrillic" and any(script_of(c) == "latin" for c in m[0] if c.isalpha()) for m, (s, _) in zip(found, scripts))
    out, at = [], 0
    for m, (script, open_), b, a in zip(found, scripts, before, after):
        target = script or (open_ and ((b if b == a else None) if b and a else b or a)) or None
        if target == "cyrillic" and len(m[0]) == 1 and m[0].isupper() and not mixed:
            continue  # a lone capital letter, as a mark or a grade
        if target in ("latin", "cyrillic"):
            table = likenesses()[target]
            word = "".join(table.get(c, c) if script_of(c) != target or c in _FORMS_OF_LATIN else c for c in m[0])
            out += [text[at : m.start()], word]
            at = m.end()
    return "".join([*out, text[at:]])


def consistent(text: str | None) -> str | None:
    """The consistent form of a text."""
    if not text or text.isascii():
        return text
    t, tool = text, transducer()
    if tool.places.search(t):
        joins = _JOINERS.search(t)
        if joins:
            t = _FLAG.sub(lambda m: m[0].translate(_FLAG_HELD), _PICTURE_JOIN.sub(lambda m: _HELD[m[0]], t))
        t = tool(t)
        if joins:
            t = t.translate(_RELEASED)
    if _FOREIGN.search(t) and (_LATIN.search(t) or not _CYRILLIC.search(t)):
        t = _words(t)
    return t


def differs(text: str | None) -> bool:
    """Whether a value holds a character that only looks like the ordinary one, an accent apart, another blank or an unseen character."""
    return bool(text) and not text.isascii() and consistent(text) != text


@F.pandas_udf(StringType())
def _consistent_udf(values: pd.Series) -> pd.Series:
    return values.map(consistent, na_action="ignore")


def consistent_form(value: Column | str) -> Column:
    """The consistent form of a column of texts, by an Arrow function; a text of plain ASCII comes back as it is."""
    c = F.col(value) if isinstance(value, str) else value
    return _consistent_udf(c)


def differing_values(articles: DataFrame, dictionaries: tuple) -> DataFrame:
    """(article_id, field, block_no, value, consistent) of titles, bylines and blocks whose consistent form differs from the
    value; wrongly decoded titles and blocks are left out. Repeated rows count once."""
    values = values_of(articles, "title", "byline")
    one = values.select("article_id", F.explode("v").alias("x")).select("article_id", "x.*").where(F.col("value").rlike("[^\\x00-\\x7f]"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = restorer(dictionaries)
        for pdf in batches:
            new = [consistent(v) for v in pdf["value"]]
            hit = [n != v and (f == "byline" or not tool.affected(v)) for n, v, f in zip(new, pdf["value"], pdf["field"])]
            out = pdf[hit].copy()
            out["consistent"] = pd.Series([n for n, h in zip(new, hit) if h], out.index, dtype=object)
            yield out

    schema = StructType([*one.schema.fields, StructField("consistent", StringType())])
    return one.mapInPandas(run, schema).distinct()


def consistent_articles(articles: DataFrame) -> DataFrame:
    """(article_id, title, byline, blocks array<string>): the consistent forms; null values stay null, values of plain ASCII aren't touched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                {
                    "article_id": pdf["article_id"],
                    "title": [consistent(v) for v in pdf["title"]],
                    "byline": [consistent(v) for v in pdf["byline"]],
                    "blocks": [None if b is None else [consistent(v) for v in b] for b in pdf["blocks"]],
                }
            )

    rows = articles.select("article_id", "title", "byline", F.transform("plain_text", lambda b: b["text"]).alias("blocks"))
    return rows.mapInPandas(run, "article_id bigint, title string, byline string, blocks array<string>")
