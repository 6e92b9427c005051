"""Language of each document and of each stretch of it, by the out-of-place distance of ranked n-grams to rank profiles.

A profile lists a language's n-grams of one to three letters from the most frequent down; it is
fitted on labelled sentences and a word list. The n-grams of a unit, a line or a whole document, are ranked by how often the unit holds them; the unit's
distance to a profile is the mean, over its n-grams, of the distance between the place in the unit's order and that in the profile. N-grams held
equally often share a place; one that the profile lacks counts as at its end. A line's evidence is joined with a
share of its neighbours', to find the languages that the document holds; the stretches of these are those of least total distance, by dynamic
programming over the lines. Places count by their logarithm, as the order of rare n-grams is chance. Case is ignored.

Defined results: null, empty and letterless texts hold no language and give no row of segments and a null language.
Whole texts count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.alphabet import bounded

#: N-grams in a profile, at most.
PROFILE = 3000
#: N-grams of a document, from the most frequent down, that are compared to the profiles.
OWN = 400
#: Entries that a table of units and counts may have beyond four for each n-gram; where it would have more, n-grams are sorted instead, with the same result.
LEAST_TABLE = 1_000_000
#: Characters of texts that are scored together; a longer text is scored whole, too, but its n-grams are counted in parts.
SLICE = 200_000
#: Share of each neighbour's evidence and the most that it counts: first to find the languages of a text, then to give each line one.
FIND, DECIDE = (0.3, 0.15), (0.1, 0.06)
#: Distances to neighbours that count: lines of two columns may alternate.
NEIGHBOURS = (1, 2)
#: A further language of a text must win so many lines by joined evidence, and lead the main one by this margin on so many lines alone.
JOINED_LINES, LEAD, LEADING_LINES = 2, 0.04, 3
#: What a change of languages from one line to the next costs.
SWITCH = 0.01
#: Letters in a line at least, that it counts as text of a language.
LETTERS = 4

#: Three-letter language codes and their two-letter ones.
CODES = {"eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "dut": "nl", "nld": "nl", "por": "pt", "ita": "it", "rus": "ru"}
NO_LANGUAGE = ("", "und", "unknown")

_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœабвгдежзийклмнопрстуфхцчшщъыьэюяё"
_W = 96  # classes of characters: 0 none, 1.. letters, then other letters
_PAD, _OTHER = _W - 1, _W - 2


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            table[i] = _OTHER
    for i, c in enumerate(_LETTERS):
        table[ord(c)] = i + 1
        if len(c.upper()) == 1:
            table[ord(c.upper())] = i + 1
    return table


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _classes()[np.minimum(codes, 0xFFFF)]


def _grams(c: np.ndarray) -> np.ndarray:
    """Numbers of the n-grams of a row of classes, which begins and ends with 0: three rows for three, two and one letters, -1 for none."""
    a, b, d = c[:-2].astype(np.int32), c[1:-1].astype(np.int32), c[2:].astype(np.int32)
    three = np.where((b > 0) & ((a > 0) | (d > 0)), (a * _W + b) * _W + d, -1)
    two = np.where((a > 0) | (b > 0), (_PAD * _W + a) * _W + b, -1)
    one = np.where(b > 0, (_PAD * _W + _PAD) * _W + b, -1)
    return np.stack([three, two, one])


def fit_profiles(samples: list[tuple[str, str]], words: list[tuple[str, str, int]]) -> dict[str, list[int]]:
    """For each language the numbers of its n-grams, most frequent first; ties by number."""
    counts: dict[str, Counter] = {}
    for lang, text in samples:
        g = _grams(np.concatenate([[0], classes_of(text), [0, 0]]).astype(np.uint8)).ravel()
        counts.setdefault(lang, Counter()).update(g[g >= 0].tolist())
    for lang, word, rank in words:
        g = _grams(np.concatenate([[0], classes_of(word), [0, 0]]).astype(np.uint8)).ravel()
        weight = 40 / (8 + (rank or 50))
        for i in g[g >= 0].tolist():
            counts.setdefault(lang, Counter())[i] += weight
    return {k: [g for g, _ in sorted(v.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for k, v in sorted(counts.items())}


class Scorer:
    """Out-of-place distances of units of text to the profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = list(profiles)
        n = len(self.langs)
        self.places = np.full((_W**3, n), _log_place(PROFILE), np.float32)
        for j, grams in enumerate(profiles.values()):
            self.places[np.array(grams, np.int64), j] = _log_place(np.arange(len(grams)))

    def distances(self, grams: np.ndarray, units: np.ndarray, n: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The out-of-place distance of each of n units to each profile, as the mean over the unit's distinct n-grams, and their number of n-grams. units: the
        unit of each n-gram. A unit's n-grams are ranked by how often it holds them, those held equally often share the first of their places; most: how
        many places, from the most frequent down, are compared; None for all. An n-gram that a profile lacks counts as at its end."""
        return self._from_counts(*_counted(units.astype(np.int64) * _W**3 + grams), n, most)

    def _from_counts(self, keys: np.ndarray, counts: np.ndarray, n: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As distances, of n-grams that are counted: keys hold the unit and the n-gram and rise."""
        if not len(keys):
            return np.zeros((n, len(self.langs))), np.zeros(n)
        unit, gram = np.divmod(keys, _W**3)
        numbers = np.bincount(unit, weights=counts, minlength=n)
        own = _shared_places(unit, counts, n)
        if most is not None:
            keep = own < most
            unit, gram, own = unit[keep], gram[keep], own[keep]
        sums = np.zeros((n, len(self.langs)))
        d = self.places[gram]
        d -= _log_place(own)[:, None]
        np.abs(d, out=d)
        distinct = np.bincount(unit, minlength=n)
        at = np.flatnonzero(distinct)
        if len(at):
            sums[at] = np.add.reduceat(d, np.concatenate([[0], np.cumsum(distinct[at])[:-1]]), axis=0)
        return sums / np.maximum(distinct, 1)[:, None], numbers

    def documents(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the lines' distances (lines, languages), their numbers of n-grams, and the text's own distances."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        group, size = [], 0
        for t in [*texts, None]:
            if group and (t is None or size + len(t) > SLICE):
                out += self._group(group)
                group, size = [], 0
            if t is not None:
                group.append(t)
                size += len(t)
        return out

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As documents, of one text of any length: its lines are worked off in groups of no more than SLICE characters, a longer line in parts."""
        means, numbers, at, end = [], [], 0, len(text)
        whole, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while at <= end:
            stop = text.rfind("\n", at, at + SLICE) if end - at > SLICE else end
            if stop < 0:
                stop = text.find("\n", at + SLICE)
                stop = end if stop < 0 else stop
            c = np.concatenate([[0], classes_of(text[at:stop]), [0, 0]]).astype(np.uint8)
            lines = text.count("\n", at, stop) + 1
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(text[at:stop].encode("utf-32-le", "surrogatepass"), np.uint32) == 10), [lines - 1]])
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for lo in range(0, len(c) - 2, SLICE):
                hi = min(lo + SLICE, len(c) - 2)
                g = _grams(c[lo : hi + 2])
                where = [np.flatnonzero(row >= 0) for row in g]
                part = np.concatenate([ends[lo + w].astype(np.int64) * _W**3 + row[w] for row, w in zip(g, where)])
                keys, counts = _added(keys, counts, *_counted(part))
            m, k = self._from_counts(keys, counts, lines)
            means.append(m)
            numbers.append(k)
            order = np.argsort(keys % _W**3, kind="stable")
            whole, number = _added(whole, number, keys[order] % _W**3, counts[order])
            at = stop + 1
        own, _ = self._from_counts(whole, number, 1, OWN)
        return np.concatenate(means), np.concatenate(numbers), own[0]

    def _group(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(texts) == 1 and len(texts[0]) > SLICE:
            return [self._long(texts[0])]
        whole = "".join([f"{t}\n" for t in texts])
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.concatenate([[0], _classes()[np.minimum(codes, 0xFFFF)], [0]]).astype(np.uint8)
        lines = np.array([t.count("\n") + 1 for t in texts])
        ends = np.cumsum(codes == 10)
        line_of = np.concatenate([[0], ends[:-1]])
        g = _grams(c)
        where = [np.flatnonzero(row >= 0) for row in g]
        grams = np.concatenate([row[w] for row, w in zip(g, where)])
        units = np.concatenate([line_of[w] for w in where])
        mean, numbers = self.distances(grams, units, int(lines.sum()))
        text_of = np.repeat(np.arange(len(texts)), lines)
        own, _ = self.distances(grams, text_of[units], len(texts), OWN)
        bounds = np.concatenate([[0], np.cumsum(lines)])
        return [(mean[a:b], numbers[a:b], own[i]) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]

    def decide(self, mean: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's language, -1 for none, and its confidence from 0 to 1. The bounds of stretches are those of least total distance, by dynamic programming."""
        n = len(mean)
        text = numbers >= 3 * LETTERS
        if not text.any():
            return np.full(n, -1), np.zeros(n)
        base = mean - mean.min(axis=1, keepdims=True)
        weight = np.minimum(1.0, numbers / 60)
        evidence = np.where(text[:, None], base * weight[:, None], 0)

        def joined(share: float, most: float) -> np.ndarray:
            near, out = np.minimum(evidence, most), evidence.copy()
            for k in NEIGHBOURS:
                if n > k:
                    out[k:] += share * near[:-k]
                    out[:-k] += share * near[k:]
            return out

        main = int(np.minimum(evidence, FIND[1])[text].sum(axis=0).argmin())
        won = np.bincount(joined(*FIND).argmin(axis=1)[text], minlength=len(self.langs))
        best = evidence.argmin(axis=1)
        leading = np.bincount(best[text & (evidence[:, main] >= LEAD)], minlength=len(self.langs))
        keep = (won >= JOINED_LINES) & (leading >= LEADING_LINES)
        keep[main] = True
        held = np.flatnonzero(keep)
        e = joined(*DECIDE)
        lang = np.full(n, -1)
        at = np.flatnonzero(text)
        lang[at] = held[_least_path(e[np.ix_(at, held)], SWITCH)] if len(held) > 1 else main
        rest = np.where(keep, np.inf, e).min(axis=1)
        chosen = e[np.arange(n), np.maximum(lang, 0)]
        if len(held) > 1:
            others = e[:, held].copy()
            others[held[None, :] == lang[:, None]] = np.inf
            rest = others.min(axis=1)
        return lang, np.where(text, 1 - np.exp(-np.maximum(rest - chosen, 0) / LEAD), 0)


    def languages(self, text: str, mean: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As decide; a further language stays only if the text of its lines, taken as one, is nearest to it of all that the document holds."""
        lang, sure = self.decide(mean, numbers)
        held = np.unique(lang[lang >= 0])
        if len(held) > 1:
            lines = text.split("\n")
            parts = self.documents(["\n".join([lines[i] for i in np.flatnonzero(lang == j)]) for j in held])
            right = np.array([held[o[held].argmin()] == j for j, (_, _, o) in zip(held, parts)])
            main = held[np.bincount(lang[lang >= 0], weights=numbers[lang >= 0], minlength=len(self.langs))[held].argmax()]
            for j in held[~right]:
                lang[lang == j] = main
        return lang, sure


def _sure(own: np.ndarray, chosen: int) -> float:
    """Confidence from 0 to 1 that a unit with these distances is in the chosen language."""
    return float(1 - np.exp(-max(np.delete(own, chosen).min() - own[chosen], 0) / LEAD)) if len(own) > 1 else 1.0


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, and how often each stands."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two counts as one."""
    both, n = np.concatenate([keys, more]), np.concatenate([counts, number])
    if not len(both):
        return both, n
    order = np.argsort(both, kind="stable")
    both, n = both[order], n[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    return both[first], np.add.reduceat(n, first)


def _shared_places(unit: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each n-gram of a unit, how many of the unit's n-grams are more frequent. unit rises."""
    most = int(counts.max()) + 1
    if n * most <= 4 * len(unit) + LEAST_TABLE:
        key = unit * most + (most - 1 - counts)
        held = np.bincount(key, minlength=n * most)
        before = np.cumsum(held) - held
        return before[key] - before[::most][unit]
    order = np.lexsort((-counts, unit))
    u, c = unit[order], counts[order]
    place = np.arange(len(u)) - np.searchsorted(u, np.arange(n))[u]
    ties = np.flatnonzero(np.append(True, (np.diff(u) != 0) | (np.diff(c) != 0)))
    out = np.empty(len(u), np.int64)
    out[order] = np.repeat(place[ties], np.diff(np.append(ties, len(u))))
    return out


def _log_place(place):
    return np.log1p(np.asarray(place, np.float32)) / np.float32(np.log1p(PROFILE))


def _least_path(e: np.ndarray, switch: float) -> np.ndarray:
    """The column of each row so that the sum of values is least, where a change of columns costs switch unless the row before the last had the same
    column, as in lines of two columns of print that alternate."""
    n, k = e.shape
    if n == 1:
        return e.argmin(axis=1)
    a, b, c = np.ogrid[:k, :k, :k]
    step = switch * ((c != b) & (c != a))  # column two rows before, one before, this one
    total = e[0][:, None] + e[1][None, :] + switch * (1 - np.eye(k))
    back = np.zeros((n, k, k), np.int8)
    for t in range(2, n):
        m = total[:, :, None] + step
        back[t] = m.argmin(axis=0)
        total = m.min(axis=0) + e[t][None, :]
    path = np.zeros(n, np.int64)
    path[n - 2], path[n - 1] = np.unravel_index(total.argmin(), total.shape)
    for t in range(n - 1, 1, -1):
        path[t - 2] = back[t][path[t - 1], path[t]]
    return path


@lru_cache(4)
def _scorer(profiles: tuple) -> Scorer:
    return Scorer({k: list(v) for k, v in profiles})


def profiles_of(samples: DataFrame, lexicon: DataFrame) -> tuple:
    """Profiles fitted on at most alphabet.TRAINING_ROWS labelled sentences and as many listed words of each language."""
    s = bounded(samples.select("lang", "text").dropna(), "text")
    w = bounded(lexicon.select("lang", "word", "word_rank").dropna(subset=["lang", "word"]), "word")
    return tuple((k, tuple(v)) for k, v in fit_profiles(s, w).items())


def label_language(label: Column) -> Column:
    """The two-letter code that a label names, in any case, with or without region; null where it names none."""
    base = F.regexp_extract(F.lower(F.trim(label)), "^([a-z]+)", 1)
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.when(F.length(base) == 2, base).when(F.length(base) == 3, F.try_element_at(codes, base))


def document_languages(documents: DataFrame, profiles: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, confidence, line_counts map<language, lines>, segments array<first_line, last_line, language, confidence>);
    lines count from 0, segments are runs of lines of one language; the language and each confidence come from the distances of the document's and the
    segment's own ranking. One row for each input row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(profiles)
        for pdf in batches:
            rows = []
            texts = [t if t is not None else "" for t in pdf[text]]
            for whole, (mean, numbers, own) in zip(texts, scorer.documents(texts)):
                lang, _ = scorer.languages(whole, mean, numbers)
                spoken = lang >= 0
                if not spoken.any():
                    rows.append((None, 0.0, {}, []))
                    continue
                counts = np.bincount(lang[spoken], minlength=len(scorer.langs))
                main = int(np.where(counts > 0, own, np.inf).argmin())
                at = np.flatnonzero(spoken)
                parts = np.split(at, np.flatnonzero(np.diff(lang[at])) + 1)
                lines = whole.split("\n")
                sure = [_sure(o, lang[part[0]]) for part, (_, _, o) in zip(parts, scorer.documents(["\n".join([lines[i] for i in part]) for part in parts]))]
                segments = [{"first_line": int(p[0]), "last_line": int(p[-1]), "language": scorer.langs[lang[p[0]]], "confidence": round(x, 4)} for p, x in zip(parts, sure)]
                share = float(numbers[lang == main].sum() / numbers[spoken].sum())
                rows.append((scorer.langs[main], round(share * _sure(own, main), 4), {scorer.langs[j]: int(c) for j, c in enumerate(counts) if c}, segments))
            out = pd.DataFrame(rows, columns=["language", "confidence", "line_counts", "segments"])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    kind = documents.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, language string, confidence double, line_counts map<string,int>, segments array<struct<first_line:int,last_line:int,language:string,confidence:double>>"
    return documents.select(key, text).mapInPandas(run, schema)


def unlabelled_languages(documents: DataFrame, profiles: tuple, lines: int = 5, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, lang): each document and language that holds at least so many of its lines and that its label does not name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(profiles)
        for pdf in batches:
            out = []
            scored = scorer.documents([t if t is not None else "" for t in pdf[text]])
            for k, named, whole, (mean, numbers, _) in zip(pdf[key].to_numpy(), pdf["_named"], pdf[text], scored):
                if len(numbers) < lines:
                    continue
                lang, _ = scorer.languages(whole, mean, numbers)
                counts = np.bincount(lang[lang >= 0], minlength=len(scorer.langs))
                out += [(k, scorer.langs[j]) for j in np.flatnonzero(counts >= lines) if scorer.langs[j] != named]
            yield pd.DataFrame(out, columns=[key, "lang"]).astype({key: pdf[key].dtype})

    kind = documents.schema[key].dataType.simpleString()
    named = documents.select(key, text, label_language(F.col(label)).alias("_named"))
    return named.mapInPandas(run, f"{key} {kind}, lang string").distinct()


def sorted_counts(counts: str) -> Column:
    """A map of counts as an array of (language, lines), by language."""
    return F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct(e["key"].alias("language"), e["value"].alias("lines"))))
