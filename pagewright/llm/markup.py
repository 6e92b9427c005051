"""Markup left standing in text blocks: found by a linear-chain conditional random field, then converted to clean text.

The chain's places are the leaf blocks of an article's plain_content in document order. A block's features are its tag and its
ancestors', the notation patterns its text matches, and measures of its text. Labels are text, markup, code and signs (lists of
tags, rules, encoded data). Weights are fitted on labelled pages that training_pages makes from labelled sentences; the
best labels are decoded by Viterbi. A block counts as markup if it is labelled so and, as an exact check, matches a notation.

Defined results: null and empty blocks are text; an article without plain_content has blocks of unknown tag.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import markup_notation as N
from pagewright.llm.alphabet import bounded
from pagewright.llm.residue import has_residue, placeholder_in

#: Labelled sentences of each language that training pages are made from, and pages made, at most; rounds of training.
TRAINING_SENTENCES, TRAINING_PAGES, ROUNDS, SEED = 250, 500, 6, 7
LABELS = ("text", "markup", "code", "signs")
TEXT, MARKUP, CODE, SIGNS = range(4)
TAGS = ("p", "h", "blockquote", "pre", "table", "li", "")
_LEAF = re.compile(r"<(p|h[1-6]|blockquote|pre|table|li)\b|<(/?)(ul|ol|blockquote)\b")
_WORD = re.compile(r"[^\W\d_]{2,}")
#: Kinds of features; each notation has one, and one that says it is matched by a block of code or of signs.
FEATURES = [
    "bias", *(f"tag {t}" for t in TAGS), "in list", "in quote", *N.NOTATIONS, "any notation", "two notations", "signs in spaces", "price or number",
    "hash words", "hash list", "few words", "no words", "repeated signs", "long words", "code words", "pairs of signs", "plain",
]
INDEX = {f: i for i, f in enumerate(FEATURES)}
_CODE_WORDS = re.compile(r"\b(?:def|return|echo|import|print|function|var|class|for|endfor|INFO|WARN|ERROR)\b.*[=({]|\d{4}-\d\d-\d\d \d\d:\d\d:\d\d (?:INFO|WARN|ERROR|DEBUG)")
_REPEAT = re.compile(r"([^\w\s]{1,4})\s*(?:\1\s*){7,}")
_SPACED = re.compile(r"\s[<>&*=^/+-]\s")
_PRICE = re.compile(r"[$#]\d|\^\d")
_HASH = re.compile(r"(?<!\S)#\w")


def leaf_tags(plain: str | None) -> list[tuple[str, bool, bool]]:
    """Tag, in a list, in a quote, of each leaf block of a cleaned page in document order."""
    out, lists, quotes = [], 0, 0
    for m in _LEAF.finditer(plain or ""):
        tag, end, outer = m[1], m[2], m[3]
        if outer:
            step = -1 if end else 1
            lists += step * (outer != "blockquote")
            quotes += step * (outer == "blockquote")
        else:
            out.append(("h" if tag[0] == "h" else tag, lists > 0 and tag != "li", quotes > 0 and tag != "blockquote"))
    return out


def features_of(text: str, tag: str, in_list: bool = False, in_quote: bool = False) -> list[int]:
    names = ["bias", f"tag {tag}"]
    names += ["in list"] * in_list + ["in quote"] * in_quote
    seen = N.shown(text)
    names += seen
    if not seen:
        names.append("plain")
    else:
        names.append("any notation")
        if len(seen) > 1:
            names.append("two notations")
    if N.QUICK.search(text) or "#" in text:
        words = _WORD.findall(text)
        names += ["signs in spaces"] * bool(_SPACED.search(text)) + ["price or number"] * bool(_PRICE.search(text))
        hashes = len(_HASH.findall(text))
        names += ["hash words"] * (hashes > 0) + ["hash list"] * (hashes > 3)
        names += ["no words"] * (not words) + ["few words"] * (sum(map(len, words)) < 0.35 * len(text))
        names += ["repeated signs"] * bool(_REPEAT.search(text)) + ["code words"] * bool(_CODE_WORDS.search(text))
        names += ["long words"] * any(len(w) > 40 for w in text.split())
    return [INDEX[n] for n in names]


class Chain:
    """Weights of a linear-chain conditional random field: by label and feature, and by label and following label."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[:, r].sum(axis=1) for r in rows])

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The best labels, by Viterbi."""
        s = self.scores(rows)
        best, back = s[0], []
        for t in range(1, len(s)):
            m = best[:, None] + self.steps
            back.append(m.argmax(axis=0))
            best = m.max(axis=0) + s[t]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def marginals(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels at each place and of pairs of labels, by forward and backward sums."""
        s = self.scores(rows)
        n, k = s.shape
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        f, b = np.zeros((n, k)), np.zeros((n, k))
        f[0] = s[0]
        for t in range(1, n):
            f[t] = lse(f[t - 1][:, None] + self.steps, 0) + s[t]
        for t in range(n - 2, -1, -1):
            b[t] = lse(self.steps + (s[t + 1] + b[t + 1])[None], 1)
        z = lse(f[-1], 0)
        pairs = np.zeros((k, k))
        for t in range(n - 1):
            pairs += np.exp(f[t][:, None] + self.steps + (s[t + 1] + b[t + 1])[None] - z)
        return np.exp(f + b - z), pairs


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, rate: float = 0.5, shrink: float = 1e-4) -> Chain:
    """Weights by stochastic gradient ascent of the likelihood with steps that adapt to each weight."""
    k = len(LABELS)
    chain = Chain(np.zeros((k, len(FEATURES))), np.zeros((k, k)))
    gw, gs = np.full(chain.weights.shape, 1e-2), np.full((k, k), 1e-2)
    order = random.Random(SEED)
    pages = list(pages)
    for _ in range(rounds):
        order.shuffle(pages)
        for rows, labels in pages:
            p, pairs = chain.marginals(rows)
            g, h = -shrink * chain.weights, -shrink * chain.steps - pairs
            for t, (r, y) in enumerate(zip(rows, labels)):
                g[:, r] -= p[t][:, None]
                g[y, r] += 1
                if t:
                    h[labels[t - 1], y] += 1
            gw += g * g
            gs += h * h
            chain.weights += rate * g / np.sqrt(gw)
            chain.steps += rate * h / np.sqrt(gs)
    return chain


#: Ways in which notations mark a word (w), a part (x) or a whole block (x) of ordinary text.
MARKS = """<b>w</b>|<i>w</i>|<em>w</em>|<strong>w</strong>|<a href="https://w.example/p1">w</a>|<span style='color:red'>x</span>|<div class="n1">x</div>|x<br/>x|<p>x</p>|x<sup>1</sup>|<ul><li>x</li></ul>|<font size="2">w</font>
&lt;em&gt;w&lt;/em&gt;|w&nbsp;w|&quot;w&quot; &amp;amp; x|w&#8217;s &#x2014; w|x &copy; w|<!-- w 1 --> x|<img src="a.png"> x|<ref name="q1">x</ref>|x <code>w</code>|<h2>x</h2>
**w**|*w*|__w__|_w_|~~w~~|[w](https://w.example/p1)|![x](https://w.example/b1.png) x|# x|## x|> x|`w_1`|```text x ``` x|x.[^1]|[^2]: x|* **w** x|* x * x|+ x|- x - x|h2. w x|bq. x
[[w|w]]|[[w]]|[[Category:w]]|[[File:w1.jpg|thumb|x]] x|'''w'''|''w''|== x ==|=== w ===|{{w|w=1}}|[https://w.example/p1 w]
\\textbf{w}|\\emph{w}|\\section{x} x|\\begin{itemize} \\item x \\end{itemize}|x~\\cite{w1}|$x_{1} = \\frac{1}{2}$|\\[ a^2 + b^2 \\leq 3 \\] x|``w''|\\( w \\)|\\footnote{x}|\\item x
[b]w[/b]|[url=https://w.example/p1]w[/url]|[quote]x[/quote] x|[i]w[/i]|[img]https://w.example/b1.png[/img]|:ref:`w`|`w`_|.. note:: x|:term:`w`"""
#: Plain signs in ordinary text, and blocks of tags and signs.
SIGNED = """She paid $40 for the w and $10 for x.|It was number #7 on the list (x^2 in the notes).|“Stars” like this * mean a w.|Grade C# was sung twice [sic].|He wrote a - b = c; then a/b = d.|x at 3 < 5 and later at a * b * c.|Note [4] says: 5 > 4 & 2 * 3 = 6.
The file plan_v2_final was w.|w & w|x (see [1])|Write to w@w.example.|x, www.w.example/p1.|w - w - w|5 % of w|w/w and w|~ 30 w|x [...] x|see § 3, no. 2|{w}, he said|w = w + 1"""
SIGN_BLOCKS = """#w #w1 #w #w2 #w #w|#w #w #w #w #w #w #w #w|= = = = = = = = = = = = = = = =|*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~|._._._._._._._._._._._._._._._._|- - - - - - - - - - - - - - - - - -|# # # # # # # # # # # # # # #|* * * * * * * * * * * *|________________________________|| | | | | | | | | | | |
w | 75,4 | -2 | w | 45,4 | 8 | w | 21,5|Aw4+xW/02kQpLmZ8yT+wBq7cVeR5uI/opAsDfGhJkLzXcVbNmQwErTyU9iO1p+aS=="""
CODE_BLOCKS = """def f_a1(b2):\n    c3 = b2 * 5 + 1\n    return c3|echo ${HOME_DIR}|{% for x in rows %}{{ x }}{% endfor %}|<%= page.title %>|print('%%TITLE%%')|Hello {{ user.name }}!|for (i = 0; i < n; i++) { a[i] = *p; }|<div class="a">w</div>|SELECT a FROM b WHERE c = 'd';|# w\nmake install|import os, sys\nos.path.join(a, b)"""


def training_pages(sentences: list[str]) -> list[tuple[list[list[int]], list[int]]]:
    """Labelled pages: sentences, some marked in one of MARKS, with plain signs, code and sign blocks among them. Always the same for the same sentences."""
    pick = random.Random(SEED)
    marks, signed, blocks, code = ([x for line in v.split("\n") for x in re.split(r"(?<!\|)\|(?!\w+\]\]|\w+=|thumb|x\]\]| )", line) if x] for v in (MARKS, SIGNED, SIGN_BLOCKS, CODE_BLOCKS.replace("\n    ", "\t").replace("\nmake", "\tmake").replace("\nos", "\tos").replace("\n", "\v")))
    code = [c.replace("\t", "\n    ").replace("\v", "\n") for c in code]
    words = [w for s in sentences for w in _WORD.findall(s)] or ["word"]

    def fill(pattern: str, sentence: str) -> str:
        out = re.sub(r"\bx\b(?![_^\]=])", lambda _: sentence, pattern)
        return re.sub(r"\bw(?=\b|\d)", lambda _: pick.choice(words), out)

    def within(piece: str, sentence: str) -> str:
        if len(piece) > len(sentence) or "x" in piece.split():
            return piece
        parts = sentence.split(" ")
        at = pick.randrange(len(parts))
        parts[at] = piece
        return " ".join(parts)

    pages = []
    for _ in range(TRAINING_PAGES):
        rows, labels, foul = [], [], pick.random() < 0.6
        for _ in range(pick.randrange(3, 12)):
            s = pick.choice(sentences)
            kind = pick.random()
            tag = pick.choice(("p", "p", "p", "p", "h", "blockquote", "li"))
            if foul and kind < 0.35:
                text, label = within(fill(pick.choice(marks), s), s), MARKUP
            elif kind < 0.55:
                text, label = f"{s} {fill(pick.choice(signed), s)}", TEXT
            elif kind < 0.63:
                tag, text, label = "pre", fill(pick.choice(code), s), CODE
            elif kind < 0.70:
                text, label = fill(pick.choice(blocks), s) * pick.randrange(1, 4), SIGNS
            else:
                text, label = s, TEXT
            rows.append(features_of(text, tag, tag == "li"))
            labels.append(label)
        pages.append((rows, labels))
    return pages


@lru_cache(4)
def _chain(weights: bytes, steps: bytes) -> Chain:
    k = len(LABELS)
    return Chain(np.frombuffer(weights).reshape(k, -1), np.frombuffer(steps).reshape(k, k))


def fit_on(samples: DataFrame) -> tuple[bytes, bytes]:
    """Weights fitted on pages made from at most TRAINING_SENTENCES labelled sentences of each language."""
    sentences = [t for _, t in bounded(samples.select("lang", "text").dropna(), "text", TRAINING_SENTENCES)]
    chain = fit(training_pages(sentences))
    return chain.weights.tobytes(), chain.steps.tobytes()


def marked_blocks(chain: Chain, texts: list[str | None], plain: str | None) -> list[int]:
    """Numbers of an article's blocks that show markup."""
    suspects = [i for i, t in enumerate(texts) if t and N.QUICK.search(t)]
    if not suspects or not any(N.shown(texts[i]) for i in suspects):
        return []
    tags = leaf_tags(plain)
    if len(tags) != len(texts):
        tags = [("", False, False)] * len(texts)
    labels = chain.decode([features_of(t or "", *tag) for t, tag in zip(texts, tags)])
    return [i for i in suspects if labels[i] == MARKUP and N.shown(texts[i])]


def marked_articles(articles: DataFrame, weights: tuple[bytes, bytes], convert: bool = False) -> DataFrame:
    """(article_id, block_no[, text, clean]): blocks whose text shows markup; articles of residue are left out. Repeated rows count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = _chain(*weights)
        for pdf in batches:
            out = []
            for key, texts, plain, content in zip(pdf["article_id"], pdf["texts"], pdf["plain_content"], pdf["content"]):
                texts = list(texts)
                found = marked_blocks(chain, texts, plain)
                if found and not has_residue(content):
                    out += [(key, i, texts[i], N.clean(texts[i])) if convert else (key, i) for i in found]
            yield pd.DataFrame(out, columns=["article_id", "block_no", "text", "clean"][: 4 if convert else 2])

    rows = articles.where(F.col("plain_text").isNotNull()).select("article_id", F.transform("plain_text", lambda b: b["text"]).alias("texts"), "plain_content", "content")
    rows = rows.where(F.exists("texts", lambda t: t.rlike(N.QUICK.pattern)))
    return rows.mapInPandas(run, "article_id bigint, block_no int" + ", text string, clean string" * convert).distinct()


_BLOCK = re.compile(r"(</?(?:p|div|h[1-6]|li|ul|ol|blockquote|table|caption|thead|tbody|tfoot|tr|td|th|section|article|header|footer|nav|aside|main|figure|figcaption|dl|dt|dd|hr|br)\b[^<>]*>|<(?:pre|script|style)\b.*?</(?:pre|script|style)\s*>)", re.S | re.I)
#: Within a block, code and tags, which stay as they are.
_INLINE = re.compile(r"<(code|kbd|samp)\b[^<>]*>.*?</\1\s*>|<!--.*?-->|<(/?)([a-zA-Z][\w-]*)\b[^<>]*>", re.S)
_OPENED, _ENDED, _PLACE = re.compile(r"<(?:(p|h[1-6]|blockquote|li|table|td|th)|ul|ol)\b", re.I), re.compile(r"</(p|h[1-6]|blockquote|li|table|ul|ol)\b", re.I), re.compile("\ue002(\\d+)\ue003")


def clean_page(chain: Chain, page: str | None) -> str | None:
    """A page's markup with the text of its blocks converted where the chain labels it as markup. Tags, code and all other blocks stay as they are."""
    if not page:
        return page
    parts = _BLOCK.split(page)
    units, open_tags = [], []
    for i, part in enumerate(parts):
        if i % 2:
            if m := _ENDED.match(part):
                while open_tags and open_tags.pop() != m[1].lower():
                    pass
            elif m := _OPENED.match(part):
                open_tags.append(m[0][1:].lower())
        elif part.strip():
            held: list[tuple[str, int]] = []
            ends: list[tuple[str, int]] = []

            def hold(m: re.Match, held=held, ends=ends) -> str:
                partner = -1
                if m[3] and not m[2]:
                    ends.append((m[3].lower(), len(held)))
                elif m[3] and ends and ends[-1][0] == m[3].lower():
                    partner = ends.pop()[1]
                    held[partner] = (held[partner][0], len(held))
                held.append((m[0], partner))
                return f"\ue002{len(held) - 1}\ue003"

            text = html.unescape(_INLINE.sub(hold, part))
            inner = next((t for t in reversed(open_tags) if t not in ("ul", "ol", "td", "th")), "")
            tag = "h" if inner[:1] == "h" else inner
            units.append((i, text, held, (tag, tag != "li" and ("ul" in open_tags or "ol" in open_tags), False)))
    shown = [_PLACE.sub("", u[1]).strip() for u in units]
    if not any(N.shown(t) for t in shown):
        return page
    labels = chain.decode([features_of(t, *u[3]) for t, u in zip(shown, units)])
    for t, label, (i, text, held, _) in zip(shown, labels, units):
        if label != MARKUP or not N.shown(t) or placeholder_in(t):
            continue
        new = html.escape(N.clean(text), quote=False).replace("\n", "<br/>")
        left = {int(k) for k in _PLACE.findall(new)}
        # a tag whose partner went with what was taken out goes, too
        new = _PLACE.sub(lambda m, held=held, left=left: held[int(m[1])][0] if held[int(m[1])][1] in left or held[int(m[1])][1] < 0 else "", new)
        lead, end = re.match(r"\s*", parts[i])[0], re.search(r"\s*$", parts[i])[0]
        parts[i] = lead + new + end
    return "".join(parts)


def cleaned_articles(articles: DataFrame, weights: tuple[bytes, bytes]) -> DataFrame:
    """(article_id, content, plain_content, blocks array<string>, found array<int>): the clean form of every content, plain_content and block, and the
    numbers of the blocks that showed markup; one row for each delivery, articles of residue too. Null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = _chain(*weights)
        for pdf in batches:
            out = []
            for key, texts, plain, content in zip(pdf["article_id"], pdf["texts"], pdf["plain_content"], pdf["content"]):
                blocks, found = None if texts is None else list(texts), []
                if blocks is not None:
                    found = [i for i in marked_blocks(chain, blocks, plain) if not placeholder_in(blocks[i])]
                    for i in found:
                        blocks[i] = N.clean(blocks[i])
                out.append((key, clean_page(chain, content), clean_page(chain, plain), blocks, found))
            yield pd.DataFrame(out, columns=["article_id", "content", "plain_content", "blocks", "found"])

    rows = articles.select("article_id", F.transform("plain_text", lambda b: b["text"]).alias("texts"), "plain_content", "content")
    return rows.mapInPandas(run, "article_id bigint, content string, plain_content string, blocks array<string>, found array<int>")
