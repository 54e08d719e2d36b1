import os

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import bpe as B

pytestmark = pytest.mark.skipif(not os.path.exists(f"{B.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="the vocabulary isn't here")
TEXTS = [
    "Plain words, aren't they? They're 12,345 things.", "", None, " ", "  two  blanks \n\n\t x", "naïve café über año", "日本語のテキスト", "🌊🌊 emoji 👩‍👩‍👧",
    "\xa0no-break em　ideographic\x85nel​", "𝐴𝑏𝑐 mathematical", "x" * 900, "ab" * 700 + "!" * 800, "0" * 600, "<|endoftext|> is text", "a\r\nb\rc", "\x00\x1c\x1f control",
    "word " * 3000, "é" * 400, "don't DON'T 'sx 'll",
]


@pytest.fixture(scope="module")
def encoder():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.vocabulary(), special_tokens={})


def test_equals_another_encoder_and_decodes(spark, encoder):
    rows = [(i, t, [0]) for i, t in enumerate(TEXTS)] + [(None, "null key", [0]), (3, "repeated key", [0])]
    df = spark.createDataFrame(rows, "k long, t string, ids array<int>")
    coded = B.encode(df, "k", "t")
    got = sorted((r.k, r.ids) for r in coded.where("k is not null").collect())
    assert got == sorted((k, encoder.encode_ordinary(t or "")) for k, t, _ in rows if k is not None)
    assert coded.where("k is null").first().ids == encoder.encode_ordinary("null key")
    back = {r.k: r.b for r in coded.where("k <> 3").select("k", B.decode(F.col("ids")).alias("b")).collect()}
    assert back == {k: t or "" for k, t, _ in rows if k is not None and k != 3}
    assert B.encode(df.limit(0), "k", "t").count() == 0


def test_heap_merges_equal_folded_ones(encoder):
    ranks = B.vocabulary()
    for w in ["a" * 32, "abcabcabc" * 40, "internationalization", "ünïcödé" * 9, "0123456789" * 60]:
        assert B.merge_long(w.encode(), ranks) == encoder.encode_ordinary(w)
        assert b"".join({v: k for k, v in ranks.items()}[i] for i in B.merge_long(w.encode(), ranks)) == w.encode()
