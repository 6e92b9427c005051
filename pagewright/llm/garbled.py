"""Text that was decoded with the wrong character encoding, and its original.

Candidates are the text itself and what chains of re-encoding and decoding make of it: UTF-8 that was
read as a single-byte encoding, in whole or in part and up to three times over, and one single-byte encoding read
as another, and that signs were lost. Each candidate's description length is its least size after compression with the dictionary of each language, plus
the cost of the chain; the shortest is chosen, and the text is left unchanged where no chain is shorter. A candidate with
characters outside ordinary text of the supported languages, or with more breaks of case than the text, is no candidate.

Defined results: null and empty text is unaffected; a text whose shortest description is that signs were lost is affected (chain lost) and can't be wholly
restored, so the restored text keeps what stands in their place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagewright.llm.alphabet import NON_ASCII, UNUSUAL, bounded

#: Single-byte encodings that text was read with, or written in.
CODECS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "mac-roman", "iso8859-15")
#: Bytes that a break of case within a word costs, and a run of signs that would be UTF-8 under a common encoding.
COST_BREAK = 1.5
#: Bytes that a sign costs that no ordinary text holds and that isn't a look-alike letter.
COST_ODD = 2.0
#: Bytes that such a sign costs beyond that at a Latin letter.
COST_WITHIN = 1.0
#: Bytes that a replacement character costs, which no original holds.
COST_REPLACEMENT = 8.0
#: Bytes that a lost letter costs, and the loss itself.
COST_LOST, COST_LOSS = 1.0, 1.0
#: Bytes that a chain costs: UTF-8 repaired, one more level of it, and an exchange of single-byte encodings.
COST_UTF8, COST_AGAIN, COST_EXCHANGE = 1.0, 0.5, 2.0
#: Bytes that an exchange costs where no odd sign or break tells of one.
COST_UNFOUNDED = 4.0
LEVELS = 3
CYRILLIC = frozenset(("cp1251", "cp866", "koi8-r"))


@lru_cache(None)
def _decoded(codec: str) -> str:
    """The 256 characters of an encoding; bytes it leaves undefined stand for themselves."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(None)
def _byte_of(codec: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(_decoded(codec))}


def _set(codec: str, lo: int, hi: int) -> str:
    return "[" + "".join(map(re.escape, _decoded(codec)[lo : hi + 1])) + "]"


@lru_cache(None)
def _sequences(codec: str) -> re.Pattern:
    c = _set(codec, 0x80, 0xBF)
    return re.compile(f"{_set(codec, 0xC2, 0xDF)}{c}|{_set(codec, 0xE0, 0xEF)}{c}{c}|{_set(codec, 0xF0, 0xF4)}{c}{c}{c}")


_RUSSIAN = re.compile("[А-Яа-яЁё]")


@lru_cache(None)
def _any_sequence() -> re.Pattern:
    """A lead and a following byte of UTF-8 under any of the encodings that aren't two Russian letters."""
    pick = lambda s, russian: "".join(re.escape(c) for c in s if bool(_RUSSIAN.match(c)) == russian)
    out = []
    for c in CODECS:
        lead, cont = _decoded(c)[0xC2:0xF5], _decoded(c)[0x80:0xC0]
        if other := pick(lead, False):
            out.append(f"[{other}][{pick(cont, False)}{pick(cont, True)}]")
        if russian := pick(lead, True):
            out.append(f"[{russian}][{pick(cont, False)}]")
    return re.compile("|".join(out))


#: Within a word: a small letter before a capital one, where one of them isn't ASCII; many accented letters in a row.
_BREAK = re.compile(r"[a-zß-öø-ÿа-яё][A-ZÀ-ÖØ-ÞА-ЯЁ]|[A-ZÀ-ÖØ-ÞА-ЯЁ]{2}[a-zß-öø-ÿа-яё]")
_ODD_BREAK = re.compile(r"[а-яё][А-ЯЁ]|[a-zß-öø-ÿ][À-ÖØ-Þ]|[А-ЯЁ]{2}[а-яё]|[à-öø-ÿ]{4}|[À-ÖØ-ß]{4}")
_TWO_SCRIPTS = re.compile("[A-Za-z][А-Яа-яЁё]|[А-Яа-яЁё][A-Za-z]")
#: Quick tests that the patterns above can match at all.
_PAIR = re.compile("[^\x00-\x7fА-Яа-яЁё][^\x00-\x7f]|[А-Яа-яЁё][^\x00-\x7fА-Яа-яЁё]")
_CAPITAL = re.compile("[À-ÖØ-ÞА-ЯЁ]|[à-öø-ÿ]{4}|ß")
_LOST = "�"
#: Signs of the encodings' upper halves that ordinary text doesn't hold; the plain no-break blank and hyphen are not among them.
_HALF = frozenset(c for k in CODECS for c in _decoded(k)[128:] if UNUSUAL.match(c)) - {"\u00a0", "\u00ad"}


#: Those of them that aren't letters of Cyrillic, nor of Greek with a Latin likeness, nor ligatures.
_ODD = frozenset(c for c in _HALF if not "\u0400" <= c <= "\u052f") - frozenset("αγιουνρτχΑΒΕΖΗΙΚΜΝΟΡΤΥΧﬁﬂ")
_SIGN = "(?:" + "|".join(map(re.escape, sorted(c for c in _ODD if not c.isalpha() or "\u0370" <= c <= "\u03ff"))) + ")"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_AT_WORD = re.compile(f"(?<={_LETTER}){_SIGN}|{_SIGN}(?={_LETTER})")
#: What stands where a sign was lost: the sign for it, or an odd sign between two letters.
_LOST_SIGNS = re.compile(f"{_LOST}|(?<={_LETTER}){_SIGN}(?={_LETTER})")


_WITH_ODD = re.compile("[^\\s“”„«»‘’—–]*[" + "".join(map(re.escape, sorted(_ODD))) + "][^\\s“”„«»‘’—–]*")


def odd_signs(text: str) -> int:
    return sum(c in _ODD for c in UNUSUAL.findall(text))


def suspicious(text: str) -> bool:
    """A quick test that every wrongly decoded text passes, and few others."""
    if text.isascii():
        return False
    if _LOST in text or (_PAIR.search(text) and _any_sequence().search(text)):
        return True
    if (_CAPITAL.search(text) and _ODD_BREAK.search(text)) or (_RUSSIAN.search(text) and _TWO_SCRIPTS.search(text)):
        return True
    return not _HALF.isdisjoint(UNUSUAL.findall(text))


@lru_cache(None)
def _leads(codec: str) -> frozenset[str]:
    return frozenset(_decoded(codec)[0xC2:0xF5])


def _repair(text: str, codec: str) -> str:
    """The text with each run of characters that is UTF-8 under the encoding decoded as such."""
    if _leads(codec).isdisjoint(text):
        return text
    byte_of = _byte_of(codec)

    def one(m: re.Match) -> str:
        try:
            c = bytes(byte_of[x] for x in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return m[0] if UNUSUAL.match(c) and not _RARE.match(c) and not _sequence_part(c) else c

    return _sequences(codec).sub(one, text)


#: Results that are unusual yet sensible: blanks, invisible signs, joined accents, letters of Greek.
_RARE = re.compile("[\u00a0\u00ad\u0300-\u036f\u200b-\u200f\u2000-\u200a\u202f\u3000\ufe0f\ufeff\u0391-\u03c9]")


#: Those of them that a restored text may hold anew.
_FINE = re.compile("[\u00a0\u00ad\u200b-\u200f\u2000-\u200a\u202f\u3000\ufe0f\ufeff\u0386-\u03ce]")


@lru_cache(1)
def _parts() -> frozenset:
    return frozenset(c for k in ("cp1252", "latin-1", "cp437", "mac-roman", "cp1251", "cp1250") for c in _decoded(k)[128:])


def _sequence_part(c: str) -> bool:
    """Whether a character may be part of UTF-8 that was wrongly read once more."""
    return c in _parts()


def candidates(text: str) -> dict[str, tuple[float, str]]:
    """Texts that chains make of a text, with the cost and the name of the cheapest chain to each."""
    out: dict[str, tuple[float, str]] = {text: (0.0, "")}
    level = [(text, 0.0, "")]
    for k in range(LEVELS):
        following = []
        for t, cost, chain in level:
            for codec in CODECS:
                r = _repair(t, codec)
                c = cost + (COST_AGAIN if k else COST_UTF8)
                if r != t and (r not in out or c < out[r][0]):
                    out[r] = (c, f"{chain}{codec}>utf-8 ")
                    following.append((r, c, out[r][1]))
        level = following
    odd = odd_signs(text) > 0 or bool(_ODD_BREAK.search(text))
    if odd or not _HALF.isdisjoint(UNUSUAL.findall(text)):
        letters = set(NON_ASCII.findall(text))
        for read in CODECS:
            byte_of = _byte_of(read)
            whole = letters <= byte_of.keys()
            for written in CODECS:
                table = _exchange(read, written)
                r = text.translate(table) if whole else _WITH_ODD.sub(lambda m: m[0].translate(table) if byte_of.keys() >= set(m[0]) else m[0], text)  # noqa: B023
                if r == text or r in out or (whole and UNUSUAL.search(r.replace("\u00a0", ""))):
                    continue
                if (read in CYRILLIC or written in CYRILLIC) and not _RUSSIAN.search(r):
                    continue
                out[r] = (COST_EXCHANGE if odd else COST_UNFOUNDED, f"{read}>{written} ")
    return out


@lru_cache(None)
def _exchange(read: str, written: str) -> dict[int, str]:
    """What each character beyond ASCII that was read by one encoding is by another."""
    return {ord(c): _decoded(written)[b] for c, b in _byte_of(read).items() if ord(c) > 127}


class Restorer:
    """Chooses among candidates by description length. content: a text of each language, from which dictionaries are made."""

    def __init__(self, content: dict[str, str]):
        import zstandard

        parameters = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.tools = {}
        for lang, text in content.items():
            data = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.tools[lang] = zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)

    def length(self, text: str) -> int:
        """The least size of a text over the dictionaries of all languages."""
        data = text.encode("utf-8", "surrogatepass")
        return min(len(tool.compress(data)) for tool in self.tools.values())

    def restore(self, text: str | None) -> tuple[str | None, str]:
        """The original text and the chain to it; the text itself and an empty chain where it is unaffected."""
        if not text or not suspicious(text):
            return text, ""
        found = candidates(text)
        without = _LOST_SIGNS.sub("", text)
        if len(found) == 1 and without == text:
            return text, ""
        breaks, odd, best = len(_BREAK.findall(text)), set(UNUSUAL.findall(text)), None
        mixed = len(_TWO_SCRIPTS.findall(text))
        for t, (cost, chain) in found.items():
            new = set(UNUSUAL.findall(t)) - odd
            if t is not text and (len(_BREAK.findall(t)) > breaks or not all(map(_FINE.match, new))):
                continue
            size = self.length(t) + cost + COST_BREAK * len(_BREAK.findall(t)) + COST_ODD * odd_signs(t) + COST_REPLACEMENT * t.count(_LOST) + COST_WITHIN * len(_AT_WORD.findall(t))
            size += COST_BREAK * (len(_sequences("cp1252").findall(t)) + len(_sequences("mac-roman").findall(t)))
            size += COST_ODD * max(0, len(_TWO_SCRIPTS.findall(t)) - mixed)
            if best is None or (size, cost) < best[:2]:
                best = (size, cost, t, chain)
        if (at := _LOST_SIGNS.sub("", best[2])) != best[2]:
            # the shortest text, or that its signs between letters were lost: one letter each
            lost = len(best[2]) - len(at)
            if self.length(at) + best[1] + COST_LOSS + COST_LOST * lost + COST_BREAK * len(_BREAK.findall(at)) < best[0]:
                return best[2], f"{best[3]}lost"
        return best[2], best[3].strip()

    def affected(self, text: str | None) -> bool:
        return bool(text) and suspicious(text) and bool(self.restore(text)[1])


def dictionaries_of(samples: DataFrame, lexicon: DataFrame) -> tuple:
    """A text of each language: listed words from the rarest to the commonest, then sentences; at most alphabet.TRAINING_ROWS of either."""
    out: dict[str, list[str]] = {}
    for lang, text in bounded(samples.select("lang", "text").dropna(), "text"):
        out.setdefault(lang, []).append(text)
    listed = bounded(lexicon.select("lang", "word", F.coalesce("word_rank", F.lit(0)).alias("word_rank")).dropna(), "word")
    for lang, word, _ in sorted(listed, key=lambda x: (x[0], -x[2], x[1])):
        out.setdefault(lang, []).append(f" {word} ")
    return tuple(sorted((k, "\n".join(v)) for k, v in out.items()))


@lru_cache(4)
def restorer(dictionaries: tuple) -> Restorer:
    return Restorer(dict(dictionaries))


def values_of(articles: DataFrame, *fields: str) -> DataFrame:
    """(article_id, v array<struct<field, block_no, value>>): the named fields and the blocks of each article's plain_text,
    those without a value left out. A block's number is its place from 0, a field's is -1."""
    parts = [F.array(F.struct(F.lit(f).alias("field"), F.lit(-1).alias("block_no"), F.col(f).alias("value"))) for f in fields]
    blocks = F.transform(F.col("plain_text"), lambda b, i: F.struct(F.lit("text").alias("field"), i.alias("block_no"), b["text"].alias("value")))
    whole = F.concat(*parts, F.coalesce(blocks, F.array().cast("array<struct<field:string,block_no:int,value:string>>")))
    return articles.select("article_id", F.filter(whole, lambda x: x["value"].isNotNull() & (x["value"] != "")).alias("v"))


def _suspects(values: DataFrame) -> DataFrame:
    """Rows of single values that aren't ASCII."""
    one = values.select("article_id", F.explode("v").alias("x")).select("article_id", "x.*")
    return one.where(F.col("value").rlike("[^\\x00-\\x7f]"))


def restored_values(articles: DataFrame, dictionaries: tuple) -> DataFrame:
    """(article_id, field, block_no, value, restored, chain): the affected titles and blocks; repeated rows count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = restorer(dictionaries)
        for pdf in batches:
            results = [tool.restore(v) for v in pdf["value"]]
            hit = [bool(c) for _, c in results]
            out = pdf[hit].copy()
            out["restored"] = pd.Series([r for r, c in results if c], out.index, dtype=object)
            out["chain"] = pd.Series([c for _, c in results if c], out.index, dtype=object)
            yield out

    suspects = _suspects(values_of(articles, "title"))
    schema = StructType([*suspects.schema.fields, StructField("restored", StringType()), StructField("chain", StringType())])
    return suspects.mapInPandas(run, schema).distinct()
