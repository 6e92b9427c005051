"""Signs of markup notations in a block of text, and their conversion to clean text."""

from __future__ import annotations

import html
import re

_BB = r"b|i|u|s|url|quote|img|code|list|size|color|center|spoiler"
#: Patterns of each notation; a block that shows none of them shows no markup.
NOTATIONS = {
    "html_tag": r"</?(?:a|abbr|b|big|blockquote|br|center|cite|code|dd|del|div|dl|dt|em|figure|figcaption|font|footer|form|h[1-6]|header|hr|i|iframe|img|ins|kbd|li|link|main|mark|nav|nowiki|ol|option|p|pre|q|ref|s|script|section|small|span|strike|strong|style|sub|sup|table|tbody|td|th|tr|tt|u|ul|video)\b(?:\s[^<>]*)?/?>",
    "html_comment": r"<!--|-->",
    "entity": r"&(?:[a-zA-Z]{2,8}|[a-zA-Z]{2,8}[0-9]{0,2}|#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,6});",
    "md_strong": r"(?<![\w*])\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?![\w*])",
    "md_emphasis": r"(?<![\w*~])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*~])",
    "md_underline": r"(?<![\w_])__(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?![\w_])|(?<![\w_.])_(?=[^\W_])[^_\n]+?(?<=[^\s_])_(?![\w_.])",
    "md_strike": r"~~(?=\S)[^~\n]+?(?<=\S)~~",
    "md_link": r"!?\[[^\[\]\n]*\]\((?:[a-z]+:|/|#|\w)[^()\s]*(?:\s+\"[^\"]*\")?\)",
    "md_heading": r"(?:^|\n)#{1,6} +(?=\S)(?!#)",
    "md_list": r"(?:^|\n)[*+] +(?=[^\W\d_]|[“„«\"])|(?:^|\n)- +(?=[^\W\d_])[^\n]*?[.!?] - +(?=[^\W\d_])",
    "textile": r"(?:^|\n)(?:h[1-6]|bq|bc)\. +(?=\S)",
    "md_quote": r"(?:^|\n)> ?(?=[^\s>\d])",
    "md_code": r"(?<!`)`(?=[^\s`])[^`\n]*`(?!`)",
    "md_fence": r"```",
    "md_note": r"\[\^[\w-]+\]",
    "md_rule": r"\|\s*:?-{3,}:?\s*\|",
    "wiki_link": r"\[\[[^\[\]\n]+\]\]",
    "wiki_outer": r"\[(?:https?|ftp)://\S+ [^\]\n]+\]",
    "wiki_quote": r"(?<!')'{2,5}(?=[^\s'])[^'\n]+?(?:'[^'\n]+)*'{2,5}(?!')",
    "wiki_heading": r"(?:^|\s)(={2,6}) (?=[^\s=])[^=\n]*(?<=[^\s=]) \1(?=\s|$)",
    "wiki_template": r"\{\{[^{}\n]+\}\}",
    "wiki_table": r"\{\||\|\}|(?:^|\n)\|-",
    "tex_command": r"\\[a-zA-Z]{2,20}\*?(?:\[[^\]\n]*\])?\{",
    "tex_word": r"\\(?:item|begin|end|par|noindent|newline|hline|maketitle|centering|quad|ldots|dots|LaTeX|TeX)\b",
    "tex_math": r"\$[^$\n]*[\\_^{}][^$\n]*\$|\\[\[\]()]",
    "tex_quote": r"``(?=\S)[^`'\n]+''",
    "bb_code": rf"\[/?(?:{_BB})(?:=[^\[\]\n]*)?\]",
    "rst_role": r"(?<!\w):[a-z]{2,20}:`[^`\n]+`",
    "rst_link": r"`[^`\n]+`_{1,2}(?!\w)|\.\. [a-z]+::",
}
COMPILED = {k: re.compile(p) for k, p in NOTATIONS.items()}
#: A quick test that every block with markup passes.
QUICK = re.compile(r"[<&*_~\[\]`{}\\$=]|''|(?:^|\n)(?:[#>+-]|(?:h[1-6]|b[qc])\. )|:[a-z]+:`|-->")
CLOSER = {"html_tag", "html_comment", "entity"}


def shown(text: str) -> set[str]:
    """Names of the patterns that a text matches."""
    if not QUICK.search(text):
        return set()
    return {k for k, p in COMPILED.items() if p.search(text)}


_STEPS = [
    (re.compile(r"<!--.*?-->", re.S), " "),
    (re.compile(r"</?(?:script|style)\b[^<>]*>", re.I), " "),
    (re.compile(r"<h([1-6])\b[^<>]*>", re.I), lambda m: "\n" + "#" * int(m[1]) + " "),
    (re.compile(r"</t[dh]\s*>\s*(?=<t[dh]\b)", re.I), " | "),
    (re.compile(r"</h[1-6]\s*>|<br\s*/?>|</?(?:p|div|ul|ol|table|tr|blockquote|section)\b[^<>]*>", re.I), "\n"),
    (re.compile(r"<li\b[^<>]*>", re.I), "\n- "),
    (re.compile(r"</li\s*>", re.I), "\n"),
    (re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", re.S | re.I), ""),
    (COMPILED["html_tag"], ""),
    (re.compile(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Ficheiro|Файл|Category|Kategorie|Catégorie|Categoría|Categoria|Категория):[^\[\]]*?(?:\|([^\[\]|]*))?\]\]"), lambda m: m[1] or ""),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?|ftp)://\S+ ([^\]\n]+)\]"), r"\1"),
    (re.compile(r"\{\{(?:lang|nowrap|nobold|small|big|abbr|transl|quote|center)\|(?:[^{}|]*\|)*([^{}|=]*)\}\}", re.I), r"\1"),
    (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"\{\|[^\n|]*"), "\n"), (re.compile(r"\n?\|\}"), "\n"), (re.compile(r"\n\|-[^\n|]*"), "\n"),
    (re.compile(r"(?<=\S) ?(?:\|\||!!) ?(?=\S)"), " | "),
    (re.compile(r"\n[|!] +"), "\n"),
    (re.compile(r"(?:^|(?<=\s))(={2,6}) (\S.*?\S|\S) \1(?=\s|$)"), lambda m: "\n" + "#" * len(m[1]) + " " + m[2] + "\n"),
    (re.compile(r"(?<![\w'])('{2,5})(?=[^\s'])((?:[^'\n]|'(?!'))+?)\1(?!')"), r"\2"),
    (re.compile(r"!\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)"), r"\1"),
    (re.compile(r"\[([^\[\]]*)\]\((?:[a-z]+:|/|#|\w)[^()\s]*(?:\s+\"[^\"]*\")?\)"), r"\1"),
    (re.compile(r"\[\^[\w-]+\]:?"), ""),
    (re.compile(r"(?<![\w*])(\*\*|__)(?=\S)(.+?)(?<=\S)\1(?![\w*])"), r"\2"),
    (COMPILED["md_emphasis"], lambda m: m[0][1:-1]),
    (COMPILED["md_underline"], lambda m: m[0].strip("_")),
    (re.compile(r"~~(.+?)~~"), r"\1"),
    (re.compile(r"(?:^|\n)> ?"), "\n"),
    (re.compile(r"(?:^|\n)h([1-6])\. +"), lambda m: "\n" + "#" * int(m[1]) + " "),
    (re.compile(r"(?:^|\n)b[qc]\. +"), "\n"),
    (re.compile(r"(?:^|\n|(?<=[.!?)]) )[*+] +(?=\S)"), "\n- "),
    (re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}|\\chapter\*?\{([^{}]*)\}"), lambda m: "\n# " + (m[1] or m[2] or "") + "\n"),
    (re.compile(r"\\item\b\s*"), "\n- "),
    (re.compile(r"\\(?:begin|end)\{[^{}]*\}"), "\n"),
    (re.compile(r"~?\\(?:cite|ref|label)[a-z]*\*?(?:\[[^\]]*\])?\{[^{}]*\}"), ""),
    (re.compile(r"\\footnote\{([^{}]*)\}"), r" (\1)"),
    (re.compile(r"``(.+?)''"), "“\\1”"),
    (re.compile(rf"\[/?(?:{_BB})(?:=[^\[\]\n]*)?\]"), ""),
]
#: What is held before anything else is changed, in order: code in fences and elements, environments of formulas, formulas, roles and links in backquotes, code in backquotes.
_PRE = re.compile(r"<pre\b[^<>]*>(.*?)</pre\s*>", re.S | re.I)
_CODE = re.compile(r"<(code|kbd|samp|tt)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
_FORMULA = re.compile(
    r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math|array|matrix|pmatrix|bmatrix|cases)(\*?)\}.*?\\end\{\1\2\}|\$\$.+?\$\$|\$[^$\n]*[\\_^{}][^$\n]*\$|\\\[.*?\\\]|\\\(.*?\\\)", re.S
)
_WIKI_FORMULA = re.compile(r"\{\{(?:math|mvar|tmath)\|(?:1=)?((?:[^{}]|\{[^{}]*\})*)\}\}|<math\b[^<>]*>(.*?)</math\s*>", re.S | re.I)
_BACKQUOTED = re.compile(r":[a-z]+:`([^`\n]+)`|`([^`\n]+?)(?: <[^<>\n]*>)?`_{1,2}(?!\w)|(?<!`)`([^`\n]+)`(?!`)")
_TEX = re.compile(r"\\[a-zA-Z]{2,20}\*?(?:\[[^\]]*\])?\{([^{}]*)\}")
_OPEN, _ALONE = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*>"), frozenset("br hr img wbr".split())


def _has_elements(text: str) -> bool:
    """Whether a text has an element that is closed or needs no end."""
    return bool(COMPILED["html_tag"].search(text)) and any(m[1].lower() in _ALONE or re.search(rf"</{m[1]}\s*>", text, re.I) for m in _OPEN.finditer(text))


def _unwrapped(text: str) -> str:
    """The text as markup: unescaped once or twice if its elements show only then."""
    if COMPILED["html_tag"].search(text) or not COMPILED["entity"].search(text):
        return text
    once = html.unescape(text)
    if once != text and _has_elements(once):
        return once
    twice = html.unescape(once)
    return twice if twice != once and _has_elements(twice) else text


def _decoded(text: str) -> str:
    """The text with its entities decoded, those written twice too."""
    return html.unescape(html.unescape(text)).replace("\u00a0", " ") if "&" in text else text


def clean(text: str) -> str:
    """The text without markup; headings begin with #, list items with -, cells of a row stand between bars, code stands between backticks as it was, formulas stay.
    What entities stand for is text: it is not taken for markup again."""
    held: list[str] = []

    def keep(x: str) -> str:
        held.append(x)
        return f"\ue000{len(held) - 1}\ue001"

    text = _unwrapped(text)
    text = re.sub(r"```.*?```", lambda m: keep(_decoded(m[0])), text, flags=re.S)
    text = _PRE.sub(lambda m: "\n" + keep("```\n" + _decoded(re.sub(r"</?[a-zA-Z][^<>]*>", "", m[1])).strip("\n") + "\n```") + "\n", text)
    text = _CODE.sub(lambda m: keep(f"`{_decoded(re.sub(r'</?[a-zA-Z][^<>]*>', '', m[2]))}`"), text)
    text = _WIKI_FORMULA.sub(lambda m: keep(f"${_decoded(m[1] or re.sub(r'</?[a-zA-Z][^<>]*>', '', m[2] or ''))}$"), text)
    text = _FORMULA.sub(lambda m: keep(_decoded(m[0])), text)
    text = _BACKQUOTED.sub(lambda m: (m[1] or m[2]) if m[1] or m[2] else keep(f"`{_decoded(m[3])}`"), text)
    for pattern, new in _STEPS:
        text = pattern.sub(new, text)
    while (new := _TEX.sub(r"\1", text)) != text:
        text = new
    text = _decoded(text)
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r" ?\n[ \n]*", "\n", text).strip()
    while (new := re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])], text)) != text:
        text = new
    return text
