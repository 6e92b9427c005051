"""Documents into containers of fixed capacity with as little unused room as possible.

Documents are sized in tokens of the container's tokenizer. As sizes are whole numbers up to the capacity, an instance of any
number of documents is no larger than a histogram with one row for each size. It is reduced after Martello and
Toth: the largest size is paired with the size that fills the container to the last token, or stands alone or with the
largest that fits where no set of several documents could fit better; such sets dominate all others with that document, so they
are fixed and leave the instance. What is left is packed by best fit, largest first. Sets of equal sizes are handled together, by
their number. Documents then get their places in the sets by rank within their size; ranks are counted by salted parts, so that no
size is one task's.

Defined results: null and empty texts have no tokens and lie in container 1; a document larger than the capacity is
split into full containers and a rest, which is packed as the others; repeated rows are documents of their own.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm import bpe
from pagewright.session import cut

#: Parts that the documents of one size are ranked in.
SALTS = 64
#: Units whose numbers of tokens a worker keeps.
MEMO = 300_000
#: Sum of capacities up to which the places of all sizes are sent to every executor; they have at most a few rows for each size.
BROADCAST_CAPACITY = 200_000


class PieceModel:
    """Numbers of tokens by a sentencepiece model. A token never reaches beyond a line or from a word into the blanks after it,
    so a text's number is the sum of its units' numbers."""

    _UNIT = re.compile(r"\n| *[^ \n]+| +")

    def __init__(self, name: str, directory: str | None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path(name, directory))
        self.base = len(self.model.encode("\n"))
        self.known: dict[str, int] = {}

    def unit(self, unit: str) -> int:
        if len(self.known) >= MEMO:
            self.known.clear()
        n = self.known[unit] = len(self.model.encode("\n" + unit)) - self.base
        return n

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        get = self.known.get
        return sum([get(u) or self.unit(u) for u in self._UNIT.findall(" " + text)])


class ByteModel:
    """Numbers of tokens by a byte-level vocabulary; both share the pieces of a text."""

    def __init__(self, name: str, directory: str | None):
        self.vocabulary = bpe.load_json(f"{name}.json", directory) if name == "byte_bpe_50k" else bpe.load_ranks(f"{name}.tiktoken", directory)
        self.known: dict[str, int] = {}

    def unit(self, piece: str) -> int:
        if len(self.known) >= MEMO:
            self.known.clear()
        n = self.known[piece] = len(self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass")))
        return n

    def __call__(self, pieces: list[str]) -> int:
        get = self.known.get
        return sum([get(p) or self.unit(p) for p in pieces])


@cache
def _model(name: str, directory: str | None):
    return PieceModel(f"{name}.model", directory) if name.startswith("piece") else ByteModel(name, directory)


def token_counts(documents: DataFrame, tokenizers: list[str], key: str = "doc_id", text: str = "text", directory: str | None = None) -> DataFrame:
    """(key, one column of tokens for each tokenizer)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {t: _model(t, directory) for t in tokenizers}
        byte = {t: m for t, m in models.items() if isinstance(m, ByteModel)}
        piece = {t: m for t, m in models.items() if isinstance(m, PieceModel)}
        cutter = bpe.Pieces() if byte else None
        for pdf in batches:
            out: dict[str, list[int]] = {t: [] for t in tokenizers}
            for value in pdf[text]:
                value = value if isinstance(value, str) else ""
                pieces = cutter(value) if cutter else []
                for t, m in byte.items():
                    out[t].append(m(pieces))
                for t, m in piece.items():
                    out[t].append(m(value))
            yield pd.DataFrame({key: pdf[key].to_numpy(), **out})

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{t} bigint" for t in tokenizers))


def pack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Sets of sizes and how often each is used: (number of containers, {size: documents in each}). counts: documents of each size from 1 to the capacity."""
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    sets: list[tuple[int, dict[int, int]]] = []

    def take(number: int, *members: int) -> None:
        content: dict[int, int] = {}
        for s in members:
            content[s] = content.get(s, 0) + 1
            left[s] -= number
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))
        sets.append((number, content))

    # reduction: fix the sets that dominate all others with their largest document
    at = len(sizes)
    while at > 0:
        at = min(at, len(sizes)) - 1
        if at < 0:
            break
        s = sizes[at]
        room = capacity - s
        while s in left:
            least = sizes[0] if sizes[0] != s or left[s] > 1 else (sizes[1] if len(sizes) > 1 else capacity + 1)
            if least > room:
                take(left[s], s)
            elif room in left and (room != s or left[s] > 1):
                take(left[s] // 2 if room == s else min(left[s], left[room]), s, room)
            elif 2 * least > room:  # only one further document fits
                i = bisect.bisect_right(sizes, room) - 1
                while i >= 0 and sizes[i] == s and left[s] < 2:
                    i -= 1
                other = sizes[i]
                take(left[s] // 2 if other == s else min(left[s], left[other]), s, other)
            else:
                break
        at = bisect.bisect_left(sizes, s)
    # best fit of the rest, largest first; containers of equal content are kept together by their room
    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def put(number: int, room: int, content: dict[int, int]) -> None:
        if room not in by_room:
            bisect.insort(rooms, room)
            by_room[room] = []
        by_room[room].append((number, content))

    for s in reversed(sizes):
        n = left[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                number, content = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
                each = min(room // s, max(1, n // number)) if n >= number else 1
                used = min(number, n // each)
                if used < number:
                    put(number - used, room, content)
                grown = dict(content)
                grown[s] = grown.get(s, 0) + each
                put(used, room - each * s, grown)
                n -= used * each
            else:
                each = max(1, min(capacity // s, n))
                used = max(1, n // each) if each <= n else 1
                put(used, capacity - each * s, {s: each})
                n -= used * each
    return sets + [x for room in rooms for x in by_room[room]]


def places(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, rank after the last, first container, documents of the size in each container)."""
    out, container, used = [], 1, {}
    for number, content in pack(counts, capacity):
        for s, each in sorted(content.items()):
            begin = used.get(s, 0)
            used[s] = begin + number * each
            out.append((s, begin, used[s], container, each))
        container += number
    return out


def packed(documents: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", directory: str | None = None) -> DataFrame:
    """(spec_id, key, piece_no, first_token, tokens, container_id): the place of each document, or of each of its parts if it is larger than a container. A part
    that fills a container has one of its own and needs no rank among its like, which may be most of all parts; its number is beyond those of the others,
    which count from 1."""
    wanted = [(r["spec_id"], r["tokenizer"], r["capacity"]) for r in specs.select("spec_id", "tokenizer", "capacity").dropna().distinct().collect()]
    names = sorted({t for _, t, _ in wanted})
    sized = cut(token_counts(documents, names, key, text, directory))
    each = F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(c).cast("bigint").alias("capacity"), F.col(t).alias("size")) for i, t, c in sorted(wanted)])
    parts = F.when(F.col("size") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.expr("(size - 1) div capacity")))
    items = (
        sized.select(key, F.explode(each).alias("x"))
        .select(key, "x.*")
        .select("*", F.explode(parts).alias("piece_no"))
        .select("spec_id", "capacity", key, F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * F.col("capacity")).alias("first_token"),
                F.least("capacity", F.expr("size - piece_no * capacity")).alias("tokens"))
    )
    salted = items.where("tokens > 0 AND tokens < capacity").withColumn("salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(SALTS)).cast("int"))
    per_salt = salted.groupBy("spec_id", "capacity", "tokens", "salt").agg(F.count("*").alias("n"))
    histogram = per_salt.groupBy("spec_id", "capacity", "tokens").agg(F.sum("n").alias("n"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = places(dict(zip(pdf["tokens"].tolist(), pdf["n"].tolist())), int(pdf["capacity"].iloc[0]))
        return pd.DataFrame(rows, columns=["tokens", "begin", "end", "container", "each"]).assign(spec_id=pdf["spec_id"].iloc[0])

    slots = histogram.groupBy("spec_id").applyInPandas(plan, "tokens bigint, begin bigint, end bigint, container bigint, each bigint, spec_id int")
    slots = cut(slots)
    last = slots.groupBy("spec_id").agg(F.max(F.expr("container + (end - begin + each - 1) div each")).alias("next"))
    alone = items.where(F.col("tokens") == F.col("capacity")).withColumn("turn", F.monotonically_increasing_id())
    whole = alone.join(F.broadcast(last), "spec_id", "left").select("spec_id", key, "piece_no", "first_token", "tokens", (F.coalesce("next", F.lit(1)) + F.col("turn")).alias("container_id"))
    slots = slots.groupBy("spec_id", "tokens").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "container", "each"))).alias("slots"))
    if sum(c for _, _, c in wanted) <= BROADCAST_CAPACITY:
        slots = F.broadcast(slots)
    by_size = Window.partitionBy("spec_id", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_salt.select("spec_id", "tokens", "salt", F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("offset"))
    within = Window.partitionBy("spec_id", "tokens", "salt").orderBy(key, "piece_no")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["spec_id", "tokens", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("offset")).join(slots, ["spec_id", "tokens"])
    mine = F.element_at(F.filter("slots", lambda x: (F.col("rank") >= x["begin"]) & (F.col("rank") < x["end"])), 1)
    ranked = ranked.withColumn("slot", mine)
    full = ranked.select("spec_id", key, "piece_no", "first_token", "tokens", (F.col("slot.container") + F.expr("(rank - slot.begin) div slot.each")).alias("container_id"))
    empty = items.where("tokens = 0").select("spec_id", key, "piece_no", "first_token", "tokens", F.lit(1).cast("bigint").alias("container_id"))
    return full.unionByName(whole).unionByName(empty)
