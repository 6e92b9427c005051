import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import bpe


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(st.one_of(st.text(max_size=80), st.text("ab cd'sé\n0١²Ж<|>", max_size=60)))
@settings(max_examples=400, deadline=None)
def test_ids_equal_those_of_the_merges_and_decode(text):
    from tokenizers import Tokenizer

    if not hasattr(test_ids_equal_those_of_the_merges_and_decode, "t"):
        t = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        test_ids_equal_those_of_the_merges_and_decode.t = t
    want = test_ids_equal_those_of_the_merges_and_decode.t.encode(text, add_special_tokens=False).ids
    v = bpe.load_json()
    assert v.encode(text) == want
    assert v.decode(want) == text


def test_pieces_without_memo_equal_brute_force():
    """The backtracking encoder against merging by rank, on pieces that aren't tokens."""
    v = bpe.load_json()
    pick = random.Random(3)
    for _ in range(300):
        piece = bytes(pick.choice(b"abcdefghijklmnopqrstuvwxyz \xc3\xa9") for _ in range(pick.randrange(1, 25)))
        parts = [v.ids[piece[i : i + 1]] for i in range(len(piece))]
        while True:
            ranked = [(v.pair[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in v.pair]
            if not ranked:
                break
            t, i = min(ranked)
            parts[i : i + 2] = [t]
        assert list(v.encode_piece(piece)) == parts


def test_special_strings_and_long_texts(reference):
    v = bpe.load_json()
    for text in ("<|endoftext|> x", "a" * 5000, " " * 3000, "word " * 4000, "\x1c\x85  x"):
        assert v.encode(text) == reference(text)


def test_rank_file_gives_the_same_vocabulary():
    a, b = bpe.load_json(), bpe.load_ranks("byte_bpe_50k.tiktoken")
    assert a.pair == b.pair and a.ids == b.ids


def test_table(spark, reference):
    rows = [(1, "Hello world", 7), (1, "Hello world", 8), (2, None, 9), (3, "", 10), (4, "naïve café 👩‍🚀", 11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode_texts(docs).collect()]
    assert sorted(got, key=lambda x: x[0]) == [(1, reference("Hello world"))] * 2 + [(2, []), (3, []), (4, reference("naïve café 👩‍🚀"))]
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode_texts(docs)).collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 4: "naïve café 👩‍🚀"}
    assert bpe.encode_texts(docs.limit(0)).collect() == []
