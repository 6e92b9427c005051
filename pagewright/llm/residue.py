"""Articles that hold template residue, filler or error text instead of real content.

Placeholders are found by one grammar for each kind of delimiter, outside of code. A placeholder that a text shows on
purpose, in a passage about templates or among program code, doesn't count: the words around it and the share
of code in the article decide. Filler, messages and notices count only as a whole element of the page, of any length, so that a sentence about
such things doesn't; messages are told by their vocabulary, not by their wording.

Defined results: null and empty content is no case; a repeated article counts once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.lookalikes import consistent
from pagewright.llm.messages import is_message

_NAME = r"[A-Za-z_][\w.-]{0,60}"
#: Grammars of unfilled placeholders by delimiter.
PLACEHOLDERS = {
    "double braces": rf"\{{\{{[#/^>&!]?\s*(?:if |each |unless |else )?\s*{_NAME}(?:\s*\|[^{{}}]{{0,40}})?\s*\}}\}}",
    "brace and percent": rf"\{{%-?\s*(?:if |for \w+ in |include |block )?\s*{_NAME}\s*-?%\}}",
    "angle and percent": rf"<%[=-]?\s*{_NAME}\s*%>",
    "query tag": rf"<\?(?:php|=)\s*(?:echo\s+)?\$?{_NAME}\s*;?\s*\?>",
    "dollar braces": rf"\$\{{\s*{_NAME}\s*\}}",
    "hash braces": rf"#\{{\s*{_NAME}\s*\}}",
    "percent signs": rf"%%{_NAME}%%",
    "at signs": rf"@@{_NAME}@@",
    "bracket and plus": rf"\[\[[+*~]{_NAME}\]\]",
    "order in brackets": rf"\[(?:INSERT|Insert|YOUR|Your|ENTER|Enter|ADD|Add)\s+{_NAME}(?:\s+{_NAME}){{0,3}}(?:\s+(?:here|HERE))?\]",
    "note in brackets": rf"\[{_NAME}\s+(?:TBD|TBA|TODO|TK)\]|\[(?:TBD|TBA|TODO|TK)\]",
    "order in angles": rf"<{_NAME}(?:\s+{_NAME}){{0,3}}\s+goes\s+here>",
}
#: Words near a placeholder that tell that the text is about it.
TUTORIAL = re.compile(r"\b(?:template|placeholder|syntax|tutorial|variable|snippet|Vorlage|Platzhalter|gabarit|plantilla|modelo|шаблон)", re.I)
#: Characters on either side of a placeholder that are looked at, and the share of code from which an article is about code.
AROUND, CODE_SHARE = 120, 0.5
#: Grammars of whole elements that a program wrote: a status code with or without its name, and a trace of an error.
STATUS = r"(?:error|http|fehler|erreur|erro|errore|fout|ошибка)[\s:]*[45]\d\d|[45]\d\d\W+(?:not found|bad gateway|forbidden|(?:internal )?server error|(?:service )?unavailable|gateway time-?out|unauthorized|bad request)|(?:not found|forbidden|unauthorized|bad gateway|gateway time-?out|service unavailable|bad request|too many requests)\W*"
TRACE = r"(?:uncaught|(?:php )?(?:fatal|parse|syntax|runtime) error|warning|notice|deprecated|traceback)\b.*?(?:exception|undefined (?:variable|index|offset|function|property)|call to (?:a|an|undefined)\b|stack trace|most recent call|in \S+ on line \d+).*"
#: An article of so few characters is nothing but its status code, if it holds one.
BARE_CODE = 40
EMPTY_VALUES = r"(?:(?:undefined|null|none|nan|\(null\)|\[object Object\]|n/a|nil)\s*)+"
#: Words of the usual meaningless Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Words of an element and share of them that must be Latin filler.
LATIN_WORDS, LATIN_SHARE = 4, 0.7

_CODE = re.compile(r"<(pre|code|samp|kbd|tt)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_FENCE = re.compile(r"```.*?```", re.S)
_BLOCK = re.compile(r"</?(?:p|div|h[1-6]|li|ul|ol|blockquote|table|tr|td|th|section|article|header|footer|br|figure|figcaption|dl|dt|dd)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_ANY_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS.values()))
_QUICK = re.compile(r"\{\{|\{%|<%|&lt;%|<\?|&lt;\?|\$\{|#\{|%%|@@|\[\[[+*~]|\[(?:INSERT|YOUR|ENTER|ADD|Insert|Your|Enter|Add|TBD|TBA|TODO|TK)\b|\b(?:TBD|TBA|TODO|TK)\]|goes here")


_PROGRAM = re.compile(rf"{EMPTY_VALUES}|{STATUS}|{TRACE}", re.I | re.S)
_CODE_ONLY = re.compile(r"\W*(?:40[0134]|410|429|50[0234])\W*")


def placeholder_in(text: str, code: int = 0) -> bool:
    """Whether a text without its code holds an unfilled placeholder. code: characters of code that were taken out."""
    for m in _ANY_PLACEHOLDER.finditer(text):
        around = text[max(0, m.start() - AROUND) : m.start()] + text[m.end() : m.end() + AROUND]
        if TUTORIAL.search(_ANY_PLACEHOLDER.sub("", around)):
            continue
        if code > CODE_SHARE * (len(text) + code) and len(text) > 0 and '"' in around[-2:]:
            continue
        return True
    return False


def is_filler(element: str) -> bool:
    words = _WORD.findall(element.lower())
    return len(words) >= LATIN_WORDS and sum(w in LATIN for w in words) >= LATIN_SHARE * len(words)


def has_residue(content: str | None) -> bool:
    """Whether an article's content has a placeholder, filler, a message or a notice where real content belongs."""
    if not content:
        return False
    text = _CODE.sub(" ", content) if "<" in content else content
    text = _FENCE.sub(" ", text) if "```" in text else text
    code = len(content) - len(text)
    if _QUICK.search(text) and placeholder_in(html.unescape(_TAG.sub(lambda m: m[0] if m[0].startswith(("<%", "<?")) else "\n", text)), code):
        return True
    shown = [p for x in _BLOCK.split(text) if x and (p := _TAG.sub("", x).strip())]
    for part in shown:
        if "&" in part:
            part = html.unescape(part)
        part = consistent(part)
        if is_message(part) or is_filler(part) or _PROGRAM.fullmatch(part):
            return True
    return sum(map(len, shown)) <= BARE_CODE and any(map(_CODE_ONLY.fullmatch, shown))


def residue_articles(articles: DataFrame) -> DataFrame:
    """(article_id): articles whose content is residue, wholly or in part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[has_residue(c) for c in pdf["content"]], ["article_id"]]

    rows = articles.select("article_id", "content").where(F.col("content").isNotNull())
    return rows.mapInPandas(run, "article_id bigint").distinct()
