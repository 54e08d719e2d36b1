"""Filling containers of fixed capacity with whole texts, by lexical retrieval.

Items are spread over shards of a bounded number of tokens. Each shard has a BM25 inverted index of
its items' tokens. The largest unused item seeds a container; the index returns its unused
neighbours, best first, and the container's window is filled from them: of the fillings that leave
the least space, one of the fewest items, so that small items stay for later gaps. What space is
then left goes to the next neighbours, and if none fits to the largest unused items that fit, whatever their
words. If a shard's containers are more than best fit over sizes alone needs, as few of the last ones as needed are
filled anew by best fit.

A shard is what one task holds: its size doesn't grow with the data. Every item is packed; each
shard ends with at most a few containers that aren't full.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.bpe import encode
from tidegraph.session import cut, table

CAPACITY = 1024
SHARD_TOKENS = 1 << 20
#: Neighbours asked for at once; more are asked for while space is left and any remain.
NEIGHBOURS = 64
K1, B = 1.2, 0.75


class Index:
    """BM25 over the items of a shard. Terms in more than half of the items weigh nothing."""

    def __init__(self, item: np.ndarray, term: np.ndarray, sizes: np.ndarray) -> None:
        n = len(sizes)
        _, term = np.unique(term, return_inverse=True)
        width = int(term.max()) + 1 if len(term) else 0
        pair, count = np.unique(item * width + term, return_counts=True) if width else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        of, what = (pair // width, pair % width) if width else (pair, pair)
        df = np.bincount(what, minlength=width)
        idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))
        keep = idf[what] > 0
        of, what, count = of[keep], what[keep], count[keep]
        length = sizes / max(1.0, sizes.mean() if n else 1.0)
        weight = idf[what] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[of]))
        self.n = n
        self.terms, self.first = what, np.searchsorted(of, np.arange(n + 1))
        order = np.argsort(what, kind="stable")
        self.posting, self.weight = of[order], weight[order]
        self.begin = np.searchsorted(what[order], np.arange(width + 1))

    def scores(self, item: int) -> np.ndarray:
        """The score of every item for the words of ``item``."""
        terms = self.terms[self.first[item] : self.first[item + 1]]
        spans = list(zip(self.begin[terms].tolist(), self.begin[terms + 1].tolist(), strict=True))
        if not spans:
            return np.zeros(self.n)
        found = np.concatenate([self.posting[a:b] for a, b in spans])
        return np.bincount(found, np.concatenate([self.weight[a:b] for a, b in spans]), self.n)


def fill(sizes: list[int], space: int) -> list[int]:
    """Which items, given in order of preference, fill ``space`` best: the greatest sum, of the fewest
    items, so that small ones stay for small gaps; of equals those of higher preference."""
    most = len(sizes) + 1
    count = np.full(space + 1, most)
    count[0] = 0
    taken = np.zeros((len(sizes), space + 1), bool)
    for i, s in enumerate(sizes):
        if s > space:
            continue
        better = count[: space + 1 - s] + 1 < count[s:]
        taken[i, s:] = better
        count[s:] = np.where(better, count[: space + 1 - s] + 1, count[s:])
    total = int(np.flatnonzero(count < most)[-1])
    out = []
    for i in range(len(sizes) - 1, -1, -1):
        if taken[i, total]:
            out.append(i)
            total -= sizes[i]
    return out[::-1]


def pack(sizes: np.ndarray, index: Index, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0."""
    n = len(sizes)
    order = np.lexsort((np.arange(n), -sizes))
    unused = np.ones(n, bool)
    container = np.full(n, -1)
    left = np.bincount(sizes, minlength=capacity + 1)

    def take(item: int, c: int) -> None:
        unused[item] = False
        container[item] = c
        left[sizes[item]] -= 1

    smallest, c = 0, 0
    by_size: dict[int, list[int]] = {}
    for i in order[::-1]:
        by_size.setdefault(int(sizes[i]), []).append(int(i))
    for seed in order:
        if not unused[seed]:
            continue
        take(seed, c)
        space = capacity - int(sizes[seed])
        while smallest <= capacity and left[smallest] == 0:
            smallest += 1
        if smallest <= space:
            s, k = index.scores(seed), min(NEIGHBOURS, n)
            while space >= smallest:  # the next neighbours, while there is space for one
                s = np.where(unused & (sizes <= space), s, 0.0)
                near = np.argpartition(-s, k - 1)[:k]
                near = near[s[near] > 0]
                if not len(near):
                    break
                near = near[np.lexsort((near, -s[near]))]
                for j in fill(sizes[near].tolist(), space):
                    take(int(near[j]), c)
                    space -= int(sizes[near[j]])
            while space >= smallest:  # whatever fits best
                at = np.flatnonzero(left[: space + 1])
                if not len(at):
                    break
                size = int(at[-1])
                pile = by_size[size]
                while not unused[pile[-1]]:
                    pile.pop()
                take(pile[-1], c)
                space -= size
        c += 1
    return container


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item by best fit, largest first, whatever the words."""
    container = np.empty(len(sizes), np.int64)
    spaces: list[tuple[int, int]] = []  # (space left, container), ascending
    n = 0
    for i in np.lexsort((np.arange(len(sizes)), -sizes)):
        size = int(sizes[i])
        at = bisect_left(spaces, (size, -1))
        if at < len(spaces):
            space, c = spaces.pop(at)
        else:
            space, c, n = capacity, n, n + 1
        container[i] = c
        if space > size:
            insort(spaces, (space - size, c))
    return container


def mended(container: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The containers, in the order they were filled, of which the last ones are filled anew by best fit if all need more
    containers than best fit over all items does: as few of the last ones as bring it down to that number."""
    if not len(container):
        return container
    filled, least = int(container.max()) + 1, int(best_fit(sizes, capacity).max()) + 1

    def rest(kept: int) -> np.ndarray:
        return np.flatnonzero(container >= kept)

    def count(kept: int) -> int:
        items = rest(kept)
        return kept + (int(best_fit(sizes[items], capacity).max()) + 1 if len(items) else 0)

    if filled <= least:
        return container
    bad, step = filled, 1
    while count(max(0, bad - step)) > least:
        bad, step = bad - step, 2 * step
    good = max(0, bad - step)
    while bad - good > 1:  # between one that does and one that doesn't
        at = (good + bad) // 2
        good, bad = (at, bad) if count(at) <= least else (good, at)
    out, items = container.copy(), rest(good)
    out[items] = good + best_fit(sizes[items], capacity)
    return out


def pack_shard(keys: pa.Array, ids: pa.ListArray, capacity: int) -> dict[str, np.ndarray]:
    """Rows (row of the shard, part, start, size, container) of a shard's texts."""
    ends = ids.offsets.to_numpy().astype(np.int64)
    tokens = ids.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    parts = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), parts)
    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = part * capacity
    size = np.minimum(capacity, sizes[row] - start)
    item = np.repeat(np.arange(len(row)), size)
    at = np.repeat(ends[row] + start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    container = mended(pack(size, Index(item, tokens[at], size), capacity), size, capacity)
    return {"row": row, "part": part, "start": start, "size": size, "container": container}


def containers(encoded: DataFrame, key: str, ids: str, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(``key``, part, start, n_tokens, container): tokens [start, start + n_tokens) of each row.

    A row of up to ``capacity`` tokens is one part; a larger one is split into full parts and a rest,
    which is packed like any other item. Rows with null or empty lists are no items. Repeated and
    null keys are items each. Containers are numbered within shards; the number is unique. Ties go by the
    key's order in the shard. An empty table gives no rows.
    """
    encoded = encoded.select(F.col(key).alias("__key"), F.col(ids).alias("__ids")).where(F.size("__ids") > 0)
    total = encoded.agg(F.sum(F.size("__ids")).alias("n")).first().n or 0
    n = max(1, -(-total // shard_tokens))
    kind = dict(encoded.dtypes)["__key"]

    def shard(k: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("__key", "ascending"), ("__h", "ascending")])
        got = pack_shard(t["__key"], t["__ids"].combine_chunks(), capacity)
        return pa.table(
            {
                "__key": t["__key"].combine_chunks().take(pa.array(got["row"])),
                "part": pa.array(got["part"], pa.int32()),
                "start": pa.array(got["start"], pa.int32()),
                "n_tokens": pa.array(got["size"], pa.int32()),
                "container": pa.array((k[0].as_py() << 32) + got["container"], pa.int64()),
            }
        )

    placed = encoded.select("*", F.xxhash64("__key", "__ids").alias("__h")).withColumn("__shard", F.pmod("__h", F.lit(n)).cast("int"))
    return placed.groupBy("__shard").applyInArrow(
        shard, f"__key {kind}, part int, start int, n_tokens int, container long"
    ).withColumnRenamed("__key", key)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of each part of one larger than a container."""
    return containers(cut(encode(table(spark, sf_dir, "documents"), "doc_id", "text")), "doc_id", "ids")


def p9_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and unused space of every container."""
    packed = p9_containers(spark, sf_dir)
    return packed.groupBy("container").agg(F.count("*").alias("n_parts"), (CAPACITY - F.sum("n_tokens")).alias("unused"))


QUERIES = {"p9_containers": p9_containers, "p9_space": p9_space}
#: Packing isn't SQL; the tests check wholeness, capacity and the space left against a bound.
ORACLE: dict[str, str] = {}
