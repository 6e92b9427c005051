"""Token ids of a byte-level BPE vocabulary by a backtracking encoder, and their decoding.

A text is cut into pieces by the vocabulary's pattern. Within a piece, an Aho-Corasick
automaton over all tokens gives the longest token at each place; a token is kept where it
is compatible with the one before, that is where merging the two tokens' bytes by the merge
rules gives just these two tokens, else the next shorter token is tried and at last the
token before is taken back. The result equals that of the merges in order. Pieces recur, so
a worker keeps the ids of up to MEMO pieces and starts anew when they are full.

Defined results: empty and null texts have no tokens and give an empty list.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces whose ids a worker keeps.
MEMO = 300_000
#: Characters over which the fast piece pattern below equals the vocabulary's own: no marks, no digits beyond decimal
#: ones, and blanks on which both pattern engines agree.
_PLAIN = re.compile("[\t\n\r -~ -±´-¸º»¿-ʯΆ-ϿЀ-҂Ҋ-ԯԱ-Ֆա-և‐-‧‰-⁞₠-₿℀←-⏿─-◿]*")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def tokenizer_path(name: str, directory: str | None = None) -> str:
    """Place of a vocabulary file; directory: a folder with the files, else the installed package's."""
    if directory:
        return f"{directory}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Pieces:
    """Cuts a text into the pieces within which tokens lie."""

    def __init__(self, pattern: str | None = None):
        import regex

        self.exact = regex.compile(pattern or piece_pattern())

    def __call__(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _FAST.findall(text)
        return self.exact.findall(text)


class Vocabulary:
    """Tokens, merges, the automaton over them and the compatibility of pairs."""

    def __init__(self, tokens: list[bytes], merges: dict[tuple[int, int], int]):
        import ahocorasick

        self.tokens = tokens
        self.pair = merges
        self.split = {t: p for p, t in merges.items()}
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.bytes = b"".join(tokens)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces = Pieces()

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the bytes of tokens a and b end in just a and b."""
        pair, split = self.pair, self.split
        limit = len(self.tokens) + 1
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                a = split[a][1] if a in split else a
                if a == limit:
                    limit = b + 1
                    b = split[b][0] if b in split else b
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = split[b][0] if b in split else b
                if b + 1 == limit:
                    limit = a
                    a = split[a][1] if a in split else a
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ids.get(piece)) is not None:
            return (whole,)
        starts: list[list[int]] = [[] for _ in range(len(piece))]
        for end, (n, i) in self.automaton.iter(piece.decode("latin-1")):
            starts[end - n + 1].append(i)
        for s in starts:
            s.sort(key=lambda i: -len(self.tokens[i]))
        out: list[int] = []
        tries: list[int] = [0]
        at, dead = 0, set()
        while at < len(piece):
            options, k, placed = starts[at], tries[-1], False
            while k < len(options):
                token = options[k]
                end = at + len(self.tokens[token])
                k += 1
                if end not in dead and (not out or self.compatible(out[-1], token)):
                    tries[-1] = k
                    out.append(token)
                    tries.append(0)
                    at, placed = end, True
                    break
            if not placed:
                dead.add(at)
                tries.pop()
                at -= len(self.tokens[out.pop()])
        return tuple(out)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        if (ids := self.known.get(piece)) is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            ids = self.known[piece] = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            out.extend(self.piece_ids(piece))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        o, b = self.offsets, self.bytes
        return b"".join(b[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the files of byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def load_json(name: str = "byte_bpe_50k.json", directory: str | None = None) -> Vocabulary:
    """The vocabulary of a file with tokens and merges."""
    with open(tokenizer_path(name, directory), encoding="utf-8") as f:
        model = json.load(f)["model"]
    signs = _byte_signs()
    special = {t for t in model["vocab"] if any(c not in signs for c in t) or t.startswith("<|")}
    ids = {t: i for t, i in model["vocab"].items() if t not in special}
    tokens = [b""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        tokens[i] = bytes(signs[c] for c in t)
    merges = {}
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[ids[a], ids[b]] = ids[a + b]
    return Vocabulary(tokens, merges)


@cache
def load_ranks(name: str, directory: str | None = None) -> Vocabulary:
    """The vocabulary of a file with ranks: each token's last merge is found by merging its bytes."""
    with open(tokenizer_path(name, directory), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    merges = {}
    for t, i in ranks.items():
        if len(t) > 1:
            parts = [t[k : k + 1] for k in range(len(t))]
            while len(parts) > 2:
                r = [ranks.get(parts[k] + parts[k + 1], 1 << 60) for k in range(len(parts) - 1)]
                if min(r) >= i:
                    break
                k = r.index(min(r))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2:
                merges[ranks[parts[0]], ranks[parts[1]]] = i
    return Vocabulary(tokens, merges)


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.json", directory: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's whole text, without special tokens. Rows that recur keep their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_json(name, directory)
        pieces, known, ids_of = vocabulary.pieces, vocabulary.known, vocabulary.piece_ids
        for batch in batches:
            flat, ends = array("i"), [0]
            for t in batch.column(1).to_pylist():
                for p in pieces(t) if t else ():
                    flat.extend(known.get(p) or ids_of(p))
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k.json", directory: str | None = None) -> DataFrame:
    """(key, text): the texts of rows of ids, by the vocabulary's table of token offsets. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_json(name, directory)
        for batch in batches:
            texts = [None if v is None else vocabulary.decode(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"{key} {kind}, text string")
