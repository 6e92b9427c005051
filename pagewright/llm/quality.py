"""Statistics of the text of each block, and its kind: prose, list, table or junk.

A Gaussian mixture with diagonal covariances is fitted to the standardised statistics of all long blocks by expectation
maximisation: each round sums responsibilities in the executors and sends a few numbers for each component to the driver. The
components start at inspected examples of each kind and are mapped to kinds after the fit, by the examples
that they answer for. Text is brought to its consistent form and right encoding first, so that odd characters alone don't make junk.

Defined results: null and empty text has zero statistics and no kind; a block of fewer characters than MIN_CHARS has no kind, nor has
code, markup, a block of an article of residue or the text of a whole plain_content. All of them have statistics.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import garbled, markup
from pagewright.llm.alphabet import bounded
from pagewright.llm.lookalikes import consistent
from pagewright.llm.residue import has_residue
from pagewright.session import BROADCAST_ROWS, cut

MIN_CHARS = 120
#: Rounds of the fit, least variance of a standardised statistic, and weight of the examples beside the data.
ROUNDS, LEAST_VARIANCE, EXAMPLE_WEIGHT = 6, 0.02, 1.0
#: Labelled sentences of each language that examples of prose are made from, at most.
EXAMPLE_SENTENCES = 40
#: Parts that each word of a joined lexicon is spread over, so that no frequent word is one task's.
SALTS = 16
KINDS = ("prose", "list", "table", "junk")
STATISTICS = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "common_share", "sentence_rate", "end_punctuation",
    "numeric_share", "lower_share", "distinct_share", "separator_rate", "longest_word", "vowel_share", "capital_share", "comma_rate",
)
#: Those that the mixture is fitted to: all but the number of words.
FITTED = STATISTICS[1:]

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_DIGIT, _NUMERIC = re.compile(r"\d"), re.compile(r"\d\S*")
_END = re.compile(r"[.!?…](?:(?<=[^\W\d_][^\W\d_].)|(?<=[)”“»\"].))[.!?…]*[”“»\"’)]*(?=\s|$)")
_SEPARATOR = re.compile(r"[|•·;\t#=/*~_<>{}\[\]+]| [-–—] |(?<=\s)\d+\.(?=\s)")
_BREAK = re.compile(r"</?(?:p|div|h[1-6]|li|ul|ol|blockquote|pre|table|thead|tbody|tr|td|th|section|article|header|footer|br|hr|figure|figcaption|dl|dt|dd)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_VOWELS, _MORE_VOWELS = "aeiouy", "àáâãäåæèéêëìíîïòóôõöøùúûüœаеёиоуыэюя"


def measure(text: str | None, common: frozenset[str]) -> tuple[float, ...]:
    """The statistics of a text, in order of STATISTICS; end_punctuation is the share of its lines that end in punctuation."""
    if not text:
        return (0.0,) * len(STATISTICS)
    small = text.lower()
    tokens, words, lowered = text.split(), _WORD.findall(text), _WORD.findall(small)
    n, w = max(len(tokens), 1), max(len(words), 1)
    letters = sum(map(len, words))
    solid = max(sum(map(len, tokens)), 1)
    digits = len(_DIGIT.findall(text))
    ends = _END.findall(text)
    lines = [x for y in text.splitlines() if (x := y.rstrip())] if "\n" in text else [text]
    return (
        float(len(words)),
        letters / w,
        (solid - letters - digits) / solid,
        digits / solid,
        sum(map(common.__contains__, lowered)) / w,
        min(len(ends) / n * 12, 1.5),
        sum([bool(_END.search(x[-12:])) for x in lines]) / max(len(lines), 1),
        (len(_NUMERIC.findall(text)) if digits else 0) / n,
        sum(map(str.islower, words)) / n,
        len(set(lowered)) / w if words else len(set(tokens)) / n,
        min(len(_SEPARATOR.findall(text)) / n, 3.0),
        float(np.log1p(max(map(len, tokens), default=0))),
        sum(map(small.count, _VOWELS if small.isascii() else _VOWELS + _MORE_VOWELS)) / max(letters, 1),
        sum(map(str.isupper, words)) / w,
        (text.count(",") + text.count(";")) / n,
    )


class Mixture:
    """A Gaussian mixture with diagonal covariances over standardised statistics."""

    def __init__(self, centre, scale, weights, means, variances, kinds):
        self.centre, self.scale = np.asarray(centre, float), np.asarray(scale, float)
        self.weights, self.means, self.variances = np.asarray(weights, float), np.asarray(means, float), np.asarray(variances, float)
        self.kinds = list(kinds)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -12, 12)

    def responsibilities(self, z: np.ndarray) -> np.ndarray:
        d = z[:, None, :] - self.means[None]
        logs = np.log(self.weights + 1e-300) - 0.5 * (np.log(self.variances).sum(axis=1) + (d * d / self.variances[None]).sum(axis=2))
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(axis=1, keepdims=True)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """For each component the sums of responsibilities, of values and of squares."""
        z = self.standard(x)
        r = self.responsibilities(z)
        return np.concatenate([r.sum(axis=0)[:, None], r.T @ z, r.T @ (z * z)], axis=1)

    def updated(self, sums: np.ndarray, examples: np.ndarray, labels: np.ndarray) -> Mixture:
        """The next round's mixture; each component also counts its own examples, so that none runs empty."""
        z = self.standard(examples)
        own = np.eye(len(self.weights))[labels] * EXAMPLE_WEIGHT
        total = sums + np.concatenate([own.sum(axis=0)[:, None], own.T @ z, own.T @ (z * z)], axis=1)
        n, k = total[:, :1], z.shape[1]
        means = total[:, 1 : k + 1] / n
        variances = np.maximum(total[:, k + 1 :] / n - means * means, LEAST_VARIANCE)
        return Mixture(self.centre, self.scale, n[:, 0] / n.sum(), means, variances, self.kinds)

    def kind_chances(self, x: np.ndarray) -> np.ndarray:
        r = self.responsibilities(self.standard(x))
        return np.stack([r[:, [k == kind for k in self.kinds]].sum(axis=1) for kind in KINDS], axis=1)


def examples(sentences: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(kind, component, text): inspected examples, made from labelled sentences and their words; the same each time for the same sentences."""
    pick = random.Random(11)
    by_lang: dict[str, list[str]] = {}
    for lang, s in sentences:
        by_lang.setdefault(lang, []).append(s)
    number = lambda a, b: str(pick.randint(a, b))
    out = []
    for lang, own in sorted(by_lang.items()):
        words = [w for s in own for w in _WORD.findall(s)]
        names = [w for w in words if w[0].isupper()] or words
        small = [w for w in words if w[0].islower()] or words
        name, word = (lambda: pick.choice(names)), (lambda: pick.choice(small))
        rows = lambda f, n=14, sep=" ": sep.join(f(i) for i in range(1, n))
        alphabet = "".join(sorted(set("".join(small).lower())))
        for s in own[:EXAMPLE_SENTENCES]:
            t = s if len(s) >= MIN_CHARS else f"{s} {pick.choice(own)}"
            out += [("prose", "prose", t), ("prose", "prose of one sentence", s), ("prose", "prose in capitals", t.upper())]
            cut_at = pick.randrange(len(t) // 2, len(t))
            out += [("prose", "prose with numbers", f"{t[:cut_at].rsplit(' ', 1)[0]} {number(1, 9999)} {t[cut_at:]} ({number(10, 9999)}).")]
            a, b = (re.split(r"[.!?] ", x)[0].rstrip(".!?") for x in (s, pick.choice(own)))
            out += [("prose", "one sentence without an end", f"{a}, {b[:1].lower()}{b[1:]}")]
            out += [("prose", "prose without an end", t.rstrip(".!?”»\"“)") + pick.choice(["", " 👍", "…", " 👩‍🚀"]))]
        for _ in range(8):
            out += [
                ("list", "numbered results", rows(lambda i: f"{i}. {name()} {name()} {name()} {number(1, 9)}:{number(10, 59)},{number(0, 9)}")),
                ("list", "names in brackets", rows(lambda i: f"{name()} {name()} ({name()}) {number(100, 999)}-{number(1000, 9999)}", sep="; ")),
                ("list", "timetable", rows(lambda i: f"{number(10, 23)}:{number(10, 59)} {name()}")),
                ("list", "items with bullets", rows(lambda i: f"• {number(1, 999)} g {word()}")),
                ("list", "words with signs", rows(lambda i: f"#{word()}{pick.choice(['', number(1, 99)])}", 24)),
                ("list", "words with slashes", rows(lambda i: f"{word().upper()} {word()}", sep=" / ")),
                ("list", "names with commas", rows(lambda i: f"{name()} {name()}", 16, ", ")),
                ("table", "cells with bars", rows(lambda i: f"{name()} | {number(1, 99)},{number(0, 9)} | {number(-9, 30)}°", sep=" | ")),
                ("table", "cells with tabs", rows(lambda i: f"{name()}\t{number(1, 999)}\t±{number(0, 9)}.{number(0, 9)}", sep="\t")),
                ("table", "cells with blanks", rows(lambda i: f"{name()} {number(1, 30)} {number(1, 20)} {number(0, 9)} {number(0, 9)} {number(1, 60)}:{number(1, 60)}")),
                ("table", "cells with quotes", rows(lambda i: f'"{name()}";{number(1, 999)};{number(1, 99)};"{word()}"')),
                ("table", "cells of one line", rows(lambda i: f"{name()} {number(1, 999)} {number(10, 99)},{number(0, 9)} {pick.choice('AB-')}")),
                ("table", "numbers", rows(lambda i: f"{number(1, 99999)}{pick.choice(['', '%', ',5', '.00'])}", 30)),
                ("junk", "log lines", rows(lambda i: f"20{number(18, 25)}-{number(10, 12)}-{number(10, 28)} {number(10, 23)}:{number(10, 59)}:{number(10, 59)} INFO job={number(1, 999)} t={number(1, 9999)}ms", 6)),
                ("junk", "random letters", rows(lambda i: "".join(pick.choice("bcdfghjklmnpqrstvwxz" "aeiou" if len(alphabet) < 60 and lang != "ru" else alphabet) for _ in range(pick.randint(2, 11))), 26)),
                ("junk", "encoded data", "".join(pick.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(160))),
                ("junk", "rule", pick.choice(["= ", "-", "*~", "# ", "._", "— ", "•  ", "~", "_"]) * 80),
                ("junk", "one word again", (word() + " ") * 30),
                ("junk", "few words again", f"{word()} {word()} {word()} " * 12),
            ]
    return out


def start(sentences: list[tuple[str, str]], common: frozenset[str], centre: np.ndarray, scale: np.ndarray) -> tuple[Mixture, np.ndarray, np.ndarray, list[str]]:
    """The mixture at the examples, the examples' statistics, their components and kinds."""
    made = examples(sentences)
    names = list(dict.fromkeys(c for _, c, _ in made))
    x = np.array([measure(t, common)[1:] for _, _, t in made])
    labels = np.array([names.index(c) for _, c, _ in made])
    kinds = [k for k, _, _ in made]
    z = np.clip((x - centre) / scale, -12, 12)
    means = np.stack([z[labels == i].mean(axis=0) for i in range(len(names))])
    variances = np.stack([np.maximum(z[labels == i].var(axis=0), 4 * LEAST_VARIANCE) for i in range(len(names))])
    weights = np.array([0.9 if n == "prose" else 0.1 / (len(names) - 1) for n in names])
    return Mixture(centre, scale, weights, means, variances, [kinds[int(np.flatnonzero(labels == i)[0])] for i in range(len(names))]), x, labels, kinds


def mapped(mixture: Mixture, x: np.ndarray, kinds: list[str]) -> Mixture:
    """The mixture with each component's kind told by the examples it answers for."""
    r = mixture.responsibilities(mixture.standard(x))
    shares = np.stack([r[[k == kind for k in kinds]].sum(axis=0) / max(1, sum(k == kind for k in kinds)) for kind in KINDS])
    mixture.kinds = [KINDS[j] for j in shares.argmax(axis=0)]
    return mixture


def common_words(lexicon: DataFrame) -> frozenset[str] | DataFrame:
    """All words of the lexicon in small letters: a set for every worker to hold or, where they are more than BROADCAST_ROWS, a written table (word) to be joined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": pd.Series([w.lower() for w in pdf["word"]], dtype=object)})

    words = cut(lexicon.select("lang", "word").dropna().select("word").mapInPandas(run, "word string").distinct())
    return words if words.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS else frozenset(r["word"] for r in words.collect())


def _common_among(texts: list[str], common: frozenset[str] | DataFrame) -> frozenset[str]:
    """The common words, or those of them that the texts hold."""
    if not isinstance(common, DataFrame):
        return common
    held = sorted({w for t in texts for w in _WORD.findall(t.lower())})
    few = common.sparkSession.createDataFrame([(w,) for w in held], "word string")
    return frozenset(r["word"] for r in common.join(F.broadcast(few), "word", "left_semi").collect())


def _with_common_share(texts: DataFrame, common: DataFrame) -> DataFrame:
    """The texts with common_share counted by a join of held, their words, with the common ones, instead of held."""
    rows = cut(texts.withColumn("_row", F.monotonically_increasing_id()))
    held = rows.select("_row", F.explode("held").alias("x")).select("_row", "x.word", "x.n", F.pmod("_row", F.lit(SALTS)).cast("int").alias("_part"))
    parts = common.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = held.join(parts, ["word", "_part"]).groupBy("_row").agg(F.sum("n").alias("hits"))
    share = F.coalesce("hits", F.lit(0)).cast("double") / F.greatest("words", F.lit(1.0))
    return rows.join(hits, "_row", "left").withColumn("common_share", share).select(*[c for c in texts.columns if c != "held"])


@lru_cache(4)
def _mixture(parameters: tuple) -> Mixture:
    return Mixture(*[np.array(p) for p in parameters[:5]], parameters[5])


def _frozen(m: Mixture) -> tuple:
    nested = lambda a: tuple(map(tuple, a)) if a.ndim == 2 else tuple(a)
    return (*(nested(a) for a in (m.centre, m.scale, m.weights, m.means, m.variances)), tuple(m.kinds))


def plain_lines(plain: str | None) -> list[str]:
    """The text of each block of a cleaned page, in order; empty ones are left out."""
    lines = (html.unescape(_TAG.sub("", x)).strip() for x in _BREAK.split(plain or ""))
    return [x for x in lines if x]


def measured_texts(articles: DataFrame, common: frozenset[str] | DataFrame, dictionaries: tuple, weights: tuple[bytes, bytes], every: bool) -> DataFrame:
    """(article_id, field, block_no, fitted, statistics...). fitted: blocks of MIN_CHARS or more that are neither code nor markup, of articles without
    residue. With every also all other blocks (field plain_text) and the whole text of each plain_content, whose block_no is null; else only fitted ones."""
    joined = isinstance(common, DataFrame)
    known = frozenset() if joined else common

    def measured(t: str | None) -> tuple:
        held = ([{"word": w, "n": n} for w, n in Counter(_WORD.findall((t or "").lower())).items()],) if joined else ()
        return (*measure(t, known), *held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, chain = garbled.restorer(dictionaries), markup._chain(*weights)
        for pdf in batches:
            out = []
            for key, texts, plain, content in zip(pdf["article_id"], pdf["texts"], pdf["plain_content"], pdf["content"]):
                texts = [] if texts is None else list(texts)
                right: dict[str, str] = {}  # blocks stand in plain_content again

                def restored(t: str, right: dict[str, str] = right) -> str:
                    if t.isascii():
                        return t
                    if t not in right:
                        right[t] = consistent(tool.restore(t)[0])
                    return right[t]

                fitted: set[int] = set()
                if any(t and len(t) >= MIN_CHARS for t in texts) and not has_residue(content):
                    left_out = set(markup.marked_blocks(chain, texts, plain))
                    tags = markup.leaf_tags(plain)
                    if len(tags) == len(texts):
                        left_out |= {i for i, t in enumerate(tags) if t[0] == "pre"}
                    fitted = {i for i, t in enumerate(texts) if t and len(t) >= MIN_CHARS and i not in left_out}
                for i, t in enumerate(texts):
                    if every or i in fitted:
                        out.append((key, "plain_text", i, i in fitted, *measured(t and restored(t))))
                if every:
                    out.append((key, "plain_content", None, False, *measured("\n".join(map(restored, plain_lines(plain))))))
            yield pd.DataFrame(out, columns=["article_id", "field", "block_no", "fitted", *STATISTICS, *(["held"] if joined else [])]).astype({"block_no": "Int32", "fitted": bool})

    rows = articles if every else articles.where(F.exists("plain_text", lambda b: F.length(b["text"]) >= MIN_CHARS))
    rows = rows.select("article_id", F.transform("plain_text", lambda b: b["text"]).alias("texts"), "plain_content", "content")
    schema = "article_id bigint, field string, block_no int, fitted boolean, " + ", ".join(f"{s} double" for s in STATISTICS)
    if not joined:
        return rows.mapInPandas(run, schema)
    return _with_common_share(rows.mapInPandas(run, f"{schema}, held array<struct<word:string,n:int>>"), common)


def fit_mixture(blocks: DataFrame, sentences: list[tuple[str, str]], common: frozenset[str], rounds: int = ROUNDS) -> Mixture:
    """The mixture fitted to all rows of statistics; without rows it stays at the examples."""
    moments = blocks.agg(*[f(s).alias(f"{n}_{s}") for s in FITTED for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    centre = np.array([moments[f"m_{s}"] or 0.0 for s in FITTED])
    scale = np.array([max(moments[f"d_{s}"] or 1.0, 0.02) for s in FITTED])
    mixture, x, labels, kinds = start(sentences, common, centre, scale)
    width = 1 + 2 * len(FITTED)
    for _ in range(rounds):
        frozen = _frozen(mixture)

        def run(batches: Iterator[pd.DataFrame], frozen=frozen) -> Iterator[pd.DataFrame]:
            m, total = _mixture(frozen), 0
            for pdf in batches:
                if len(pdf):
                    total = total + m.sums(pdf.to_numpy(float))
            if not isinstance(total, int):
                yield pd.DataFrame({"k": np.arange(len(total)), **{f"s{j}": total[:, j] for j in range(width)}})

        parts = blocks.select(*FITTED).mapInPandas(run, "k int, " + ", ".join(f"s{j} double" for j in range(width)))
        sums = np.zeros((len(mixture.weights), width))
        for r in parts.groupBy("k").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).collect():
            sums[r["k"]] = [r[f"s{j}"] for j in range(width)]
        mixture = mixture.updated(sums, x, labels)
    return mapped(mixture, x, kinds)


def text_kinds(articles: DataFrame, samples: DataFrame, lexicon: DataFrame, every: bool = True) -> DataFrame:
    """(article_id, field, block_no, statistics..., kind, chance) of every plain_content and every block, a row for each delivery; kind and chance are
    null but for blocks of MIN_CHARS or more that aren't code, markup or residue. Without every, only these have rows."""
    sentences = bounded(samples.select("lang", "text").dropna(), "text")
    common = common_words(lexicon)
    texts = cut(measured_texts(articles, common, garbled.dictionaries_of(samples, lexicon), markup.fit_on(samples), every))
    frozen = _frozen(fit_mixture(texts.where("fitted"), sentences, _common_among([t for _, _, t in examples(sentences)], common)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = _mixture(frozen)
        for pdf in batches:
            fitted = pdf["fitted"].to_numpy(bool)
            kind, chance = np.full(len(pdf), None, object), np.full(len(pdf), None, object)
            if fitted.any():
                p = m.kind_chances(pdf.loc[fitted, list(FITTED)].to_numpy(float))
                kind[fitted], chance[fitted] = np.array(KINDS, object)[p.argmax(axis=1)], p.max(axis=1)
            yield pdf.drop(columns="fitted").assign(block_no=pdf["block_no"].astype("Int32"), kind=kind, chance=pd.array(chance, "Float64"))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.drop("fitted").schema)
    return texts.mapInPandas(run, f"{fields}, kind string, chance double")


def other_than_prose(articles: DataFrame, samples: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(article_id, block_no): long blocks that are a list, a table or junk. Repeated rows count once."""
    return text_kinds(articles, samples, lexicon, every=False).where(F.col("kind") != "prose").select("article_id", "block_no").distinct()
