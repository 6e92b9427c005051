"""Characters that ordinary text of the supported languages is written with, and bounded samples of labelled rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows of each language that a model is fitted on, at most; those whose hash is least.
TRAINING_ROWS = 10_000

#: Letters beyond a to z of each language, small ones; capitals follow.
LETTERS = {
    "en": "éèçïöñ",
    "de": "äöüß",
    "fr": "àâæçéèêëîïôœùûüÿ",
    "es": "áéíñóúü",
    "nl": "áéèëïíóöúü",
    "pt": "áâãàçéêíóôõúü",
    "it": "àèéìíîòóùú",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
    "names": "åøæäöéüñçœ",
}
#: Typographic signs in ordinary use.
SIGNS = "«»“”„‘’‚‹›–—―…•·°§©®™€£¥¿¡№×±½¼¾µ′″†"
SMALL = "".join(sorted({c for v in LETTERS.values() for c in v}))
PLAIN = frozenset(map(chr, range(32, 127))) | set("\t\n\r") | set(SMALL) | set(SMALL.upper()) - {"S"} | set(SIGNS)
PICTURES = "\U0001f000-\U0001faff☀-➿⭐⭕"

_BEYOND = re.compile("[^" + "".join(map(re.escape, sorted(PLAIN))) + "]")
_PICTURE = re.compile(f"[{PICTURES}]")


class _Unusual:
    """Characters beyond the ordinary ones and pictures. The class to search for has no ranges beyond the basic plane, which are slow."""

    def findall(self, text: str) -> list[str]:
        return [c for c in _BEYOND.findall(text) if not _PICTURE.match(c)]

    def search(self, text: str) -> bool:
        return bool(_BEYOND.search(text)) and bool(self.findall(text))

    def match(self, c: str) -> bool:
        return bool(_BEYOND.match(c)) and not _PICTURE.match(c)


UNUSUAL = _Unusual()
NON_ASCII = re.compile("[^\x00-\x7f]")


def bounded(labelled: DataFrame, text: str, most: int | None = None) -> list[tuple]:
    """At most so many labelled rows of each lang, TRAINING_ROWS if not given, chosen by the hash of their text, in order of lang and text."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(text), text))
    rows = labelled.withColumn("_place", place).where(F.col("_place") <= (most or TRAINING_ROWS)).drop("_place")
    return [tuple(r) for r in rows.orderBy("lang", *[c for c in labelled.columns if c != "lang"]).collect()]
