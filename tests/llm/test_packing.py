import itertools
import random
from collections import Counter

import pytest

from pagewright.llm import packing


def fewest(sizes, capacity):
    """The least number of containers, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_sets_are_valid_and_close_to_the_fewest():
    pick = random.Random(5)
    over = 0
    for _ in range(120):
        capacity = pick.randrange(3, 20)
        sizes = [pick.randrange(1, capacity + 1) for _ in range(pick.randrange(1, 10))]
        sets = packing.pack(Counter(sizes), capacity)
        used = Counter()
        for number, content in sets:
            assert number > 0 and sum(s * n for s, n in content.items()) <= capacity
            for s, n in content.items():
                used[s] += n * number
        assert used == Counter(sizes)
        over += sum(n for n, _ in sets) - fewest(sizes, capacity)
    assert over <= 6


def test_reduction_alone_is_optimal_for_pairs_that_fill():
    assert sum(n for n, _ in packing.pack({6: 5, 4: 5, 10: 2}, 10)) == 7
    assert packing.pack({}, 10) == [] and packing.pack({10: 3}, 10) == [(3, {10: 1})]
    assert sum(n for n, _ in packing.pack({5: 1_000_001}, 10)) == 500_001


def test_places_cover_all_ranks():
    counts = {3: 7, 4: 5, 9: 2, 1: 11}
    for s in counts:
        own = sorted((b, e) for size, b, e, _, _ in packing.places(counts, 10) if size == s)
        assert own[0][0] == 0 and own[-1][1] == counts[s] and all(x[1] == y[0] for x, y in itertools.pairwise(own))


def test_table(spark):
    texts = [(i, "word " * (i * 7 % 50)) for i in range(200)] + [(500, "long text " * 400), (501, None), (502, ""), (500, "long text " * 400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id bigint, text string, tokens string")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "piece_bpe_32k", 100)], "spec_id int, tokenizer string, capacity int")
    rows = packing.packed(docs, specs).collect()
    sizes = {r["doc_id"]: r for r in packing.token_counts(docs, ["byte_bpe_50k", "piece_bpe_32k"]).collect()}
    for spec, name, capacity in ((1, "byte_bpe_50k", 64), (2, "piece_bpe_32k", 100)):
        own = [r for r in rows if r["spec_id"] == spec]
        load = Counter()
        for r in own:
            load[r["container_id"]] += r["tokens"]
        assert max(load.values()) <= capacity and min(load) == 1
        assert sum(load.values()) == sum(sizes[i][name] for i, _ in texts)
        assert len(load) <= -(-sum(load.values()) // capacity) * 1.05 + 1
        split = Counter(r["doc_id"] for r in own)
        assert all(n == 1 for i, n in split.items() if i < 200 and sizes[i][name] <= capacity)
        assert {r["container_id"] for r in own if r["tokens"] == 0} <= {1}
    assert packing.packed(docs.limit(0), specs).count() == 0


def test_unit_sums_equal_whole_texts():
    import sentencepiece

    from pagewright.llm import bpe

    whole = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))
    m = packing._model("piece_bpe_32k", None)
    for t in ("", " ", "a", "  a  b ", "\n", "a\n", "\n a", "日本 語", "x \n y", "▁a b", "\t a", "naïve " * 50):
        assert m(t) == len(whole.encode(t))


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_byte_counts_equal_an_encoding(name):
    import base64

    import public_tokenizers as P
    import tiktoken

    from pagewright.llm import bpe

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(f"{name}.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    m, cutter = packing._model(name, None), bpe.Pieces()
    for t in ("", "Ein alter Uhrmacher", "старый часовщик  \n", "x" * 500, "1234 5678 — ok"):
        assert m(cutter(t)) == len(e.encode_ordinary(t))
