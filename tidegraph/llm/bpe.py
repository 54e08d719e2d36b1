"""Encoding with a public byte-level BPE vocabulary, by Spark's higher-order functions.

Merges are folded once per distinct word of the corpus, not per occurrence. A word is an array of
byte strings (hexadecimal), and ``aggregate`` merges the neighbours of the lowest rank until none
is left. The rank map is a literal of the expression: an array of buckets by CRC-32 with a small map
each, because Spark searches a map from its start.

Texts are spread over shards of bounded size. Each shard's distinct words meet the encoded words in
one join, whose rows are words per shard and not occurrences, and are put back in place by array
lookups over whole Arrow columns. No word's occurrences gather in one task.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import cut, table

#: Where the vocabulary files are.
TOKENIZERS = os.environ.get("TIDEGRAPH_TOKENIZERS", "/opt/tokenizers")
#: The public pattern that splits text before the merges, for Java. White space is
#: spelled out, since Java's \s is ASCII only.
_SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
BUCKETS = 16384
#: No rank: greater than any.
NONE = 2**31 - 1
#: Longer words, in bytes, are merged with a heap, which needs no time in proportion to the square.
LONG = 256
#: Bytes of text a shard aims at.
SHARD_BYTES = 4 << 20


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def vocabulary(name: str = "byte_bpe_50k") -> dict[bytes, int]:
    return read_ranks(os.path.join(TOKENIZERS, f"{name}.tiktoken"))


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<hex, id>> as a constant of the plan."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """Names a value inside an expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of one word by folding ranked merges over its bytes; for words of up to LONG bytes."""
    # The literal is named once: each mention of it would be another copy in the plan.
    return _let(rank_literal(ranks), lambda literal: _fold(word, literal))


def _fold(word: Column, literal: Column) -> Column:
    def rank(piece: Column) -> Column:
        bucket = F.get(literal, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int"))
        return F.coalesce(F.try_element_at(bucket, piece), F.lit(NONE))

    code = F.hex(F.encode(word, "UTF-8"))
    n = (F.length(code) / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(code, (i * 2 + 1).cast("int"), F.lit(2)))

    def between(p: Column) -> Column:
        return F.when(F.size(p) < 2, F.array().cast("array<int>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: rank(F.concat(F.get(p, i), F.get(p, i + 1))))
        )

    def step(acc: Column, _: Column) -> Column:
        p, r = acc.p, acc.r

        def merged(at: Column) -> Column:  # at: the 1-based place of the leftmost lowest rank
            i = at.cast("int")
            joined = F.concat(F.get(p, i - 1), F.get(p, i))
            return _let(
                joined,
                lambda j: F.struct(
                    F.concat(F.slice(p, F.lit(1), i - 1), F.array(j), F.slice(p, i + 2, F.size(p))).alias("p"),
                    F.concat(
                        F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))),
                        F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), j)))).otherwise(F.array().cast("array<int>")),
                        F.when(i + 1 < F.size(p), F.array(rank(F.concat(j, F.get(p, i + 1))))).otherwise(F.array().cast("array<int>")),
                        F.slice(r, i + 2, F.size(p)),
                    ).alias("r"),
                ),
            )

        lowest = F.array_min(r)
        return F.when(F.coalesce(lowest, F.lit(NONE)) == NONE, acc).otherwise(_let(F.array_position(r, lowest), merged))

    start = _let(pieces, lambda p: F.struct(p.alias("p"), between(p).alias("r")))
    end = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc.p)
    return F.transform(end, rank)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list: n log n."""
    n = len(word)
    piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        a = piece[i]
        j = after[i]
        if a is None or j >= n or len(a) + len(piece[j]) != size:  # one of the two has changed since
            continue
        joined = a + piece[j]
        piece[i], piece[j] = joined, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            rank = ranks.get(joined + piece[after[i]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, size + len(piece[after[i]])))
        h = before[i]
        if h >= 0:
            rank = ranks.get(piece[h] + joined)
            if rank is not None:
                heapq.heappush(heap, (rank, h, size + len(piece[h])))
    return [ranks[p] for p in piece if p is not None]


def _long_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """The same for longer words. The ranks travel with the function: executors need no files."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: merge_long(w.encode(), ranks))

    return run(word)


def _lookup(key: tuple, docs: pa.Table, words: pa.Table) -> pa.Table:
    """Puts the ids of the words in the place of the words, for all texts of a shard at once."""
    lists = docs["__words"].combine_chunks()
    ids = words["__ids"].combine_chunks()
    spelled = words["__word"].combine_chunks()
    flat = lists.flatten()
    at = pc.index_in(flat, value_set=spelled).to_numpy(zero_copy_only=False).astype(np.int64)
    count, start = np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.offsets.to_numpy().astype(np.int64)[:-1]
    count, start = (count[at], start[at]) if len(spelled) else (np.zeros(0, np.int64),) * 2
    ends = np.r_[0, np.cumsum(count)]
    where = np.repeat(start - ends[:-1], count) + np.arange(ends[-1])
    values = ids.values.to_numpy(zero_copy_only=False)[where] if len(spelled) else np.zeros(0, np.int32)
    edges = lists.offsets.to_numpy().astype(np.int64)
    out = pa.LargeListArray.from_arrays(pa.array(ends[edges - edges[0]], pa.int64()), pa.array(values, pa.int32())).cast(pa.list_(pa.int32()))
    return pa.table({"__key": docs["__key"].combine_chunks(), "ids": out})


def shard_count(texts: DataFrame, text: str, shard_bytes: int = SHARD_BYTES) -> int:
    size = texts.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // shard_bytes))


def encode(docs: DataFrame, key: str, text: str, name: str = "byte_bpe_50k") -> DataFrame:
    """(``key``, ids): the token ids of each row's text, without special tokens.

    Null and empty texts give an empty list. Strings that look like special tokens are ordinary
    text. Rows with a repeated or null key each give a row. Extra columns are dropped; an empty
    table gives no rows. Texts and words of any length are encoded whole.
    """
    ranks = vocabulary(name)
    n = shard_count(docs, text)
    placed = docs.select(
        F.col(key).alias("__key"), F.col(text).alias("__text"), F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n)).cast("int").alias("__shard")
    ).repartition(n, "__shard")
    split = placed.select(
        "__key", "__shard", F.regexp_extract_all(F.coalesce("__text", F.lit("")), F.lit(PATTERN), F.lit(0)).alias("__words")
    )
    # Read twice, so written once: the words of the corpus' shards are far fewer than its occurrences.
    per_shard = cut(split.select("__shard", F.explode("__words").alias("__word")).distinct())
    distinct = per_shard.select("__word").distinct()
    long = F.octet_length("__word") > LONG
    encoded = (
        distinct.where(~long)
        .select("__word", merge_words(F.col("__word"), ranks).alias("__ids"))
        .unionByName(distinct.where(long).select("__word", _long_words(F.col("__word"), ranks).alias("__ids")))
    )
    words = per_shard.join(encoded, "__word").select(F.col("__shard").alias("__of"), "__word", "__ids")
    kind = dict(docs.dtypes)[key]
    out = split.groupBy("__shard").cogroup(words.groupBy("__of")).applyInArrow(_lookup, f"__key {kind}, ids array<int>")
    return out.withColumnRenamed("__key", key)


def decode(ids: Column, name: str = "byte_bpe_50k") -> Column:
    """The text of a list of ids: binary pieces, concatenated. A null list gives null; unknown ids
    give nothing."""
    ranks = vocabulary(name)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(literal, i), F.lit(""))), "")), "UTF-8")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: tokens, characters after decoding, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens"), decode(F.col("ids")).alias("back"))
    return docs.join(back, "doc_id").select(
        "doc_id", "n_tokens", F.length("back").alias("n_chars"), (F.col("back") == F.coalesce("text", F.lit(""))).alias("same")
    )


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip}
#: Merges aren't SQL; the tests hold the ids against an independent encoder.
ORACLE: dict[str, str] = {}
