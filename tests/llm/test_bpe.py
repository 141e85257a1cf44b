import random
from pathlib import Path

import pytest

from chatloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
PATH = Path(bpe.TOKENIZERS) / bpe.VOCABULARY
pytestmark = pytest.mark.skipif(not PATH.exists(), reason="no vocabulary here")

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_vocabulary(PATH)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "\n\n  x", "it's they'll I'd we've", "<|endoftext|> plain", "日本語 и кириллица x", "a​b﻿", "\x85  end  ", "12345 67 x²½", "👨‍👩‍👧 🤷‍♀️", "tab\tand\r\nlines\r\n\r\n",
    "    indented", "trailing   ", "\x1c\x1d separators", "ааааааааааааааааа", "x" * 3000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_public_encoder(both, text):
    mine, theirs = both
    assert mine.encode(text) == theirs.encode_ordinary(text)
    assert theirs.decode(mine.encode(text)) == text


def test_random_texts(both):
    mine, theirs = both
    rng = random.Random(4)
    letters = "  eeeetttaaonsABZ'\n\t.,-_01éж中\U0001f600 　"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert mine.encode(text) == theirs.encode_ordinary(text)


def test_long_unbroken_text(both):
    mine, theirs = both
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    assert mine.encode(text) == theirs.encode_ordinary(text)
    assert len(mine.encode("a" * 300_000)) > 0  # linear: seconds, not hours


def test_tables(spark, both):
    mine, _ = both
    rows = [(1, None, "k"), (2, "", "k"), (3, "hello world", None), (3, "hello world", None), (None, "x", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in bpe.encode_texts(df).collect())
    hello = mine.encode("hello world")
    assert got == [(0, mine.encode("x")), (1, []), (2, []), (3, hello), (3, hello)]
    counts = bpe.count_tokens(df.drop("ids")).collect()
    assert sorted(r.n_tokens for r in counts) == [0, 0, 1, 2, 2] and "text" not in counts[0].asDict()
    assert bpe.encode_texts(df.where("false")).collect() == []


def test_a_vocabulary_without_a_byte_is_refused():
    from chatloom.llm.bpe import Encoder

    with pytest.raises(ValueError):
        Encoder({b"a": 0, b"b": 1}).encode("abc")
    assert Encoder({b"a": 0, b"b": 1, b"ab": 2}).encode("abab") == [2, 2]
