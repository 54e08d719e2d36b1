import random
from collections import Counter, defaultdict

import numpy as np

from tidegraph.llm import packing as P

SCHEMA = "k long, ids array<int>, start int"


def best_fit(sizes):
    """Containers that best-fit decreasing needs."""
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [x for x in left if x >= s]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - s)
        else:
            left.append(1024 - s)
    return len(left)


def packed(spark, rows, **options):
    return P.containers(spark.createDataFrame(rows, SCHEMA), "k", "ids", **options).collect()


def test_whole_items_within_capacity_and_little_space(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(500) for _ in range(rng.choice([3, 20, 60, 150, 400, 900]))], 0) for i in range(300)]
    rows += [(900, list(range(2500)), 0), (901, list(range(1024)), 0), (902, [], 0), (903, None, 0), (None, [1, 2], 0), (5, [1] * 7, 0)]
    got = packed(spark, rows)
    fill, parts = Counter(), defaultdict(list)
    for r in got:
        fill[r.container] += r.n_tokens
        parts[r.k].append((r.part, r.start, r.n_tokens))
    total = sum(len(ids or []) for _, ids, _ in rows)
    assert max(fill.values()) <= 1024 and sum(fill.values()) == total
    assert len(fill) <= best_fit([min(1024, n) for _, ids, _ in rows for n in ([len(ids)] if ids and len(ids) <= 1024 else [1024, 1024, 452] if ids else [])])
    assert sorted(parts[900]) == [(0, 0, 1024), (1, 1024, 1024), (2, 2048, 452)] and parts[901] == [(0, 0, 1024)]
    assert 902 not in parts and 903 not in parts and parts[None] == [(0, 0, 2)] and len(parts[5]) == 2
    assert all(len(p) == 1 for k, p in parts.items() if k not in (900, 5))
    assert packed(spark, []) == []


def test_shards_are_bounded_and_numbers_unique(spark):
    rows = [(i, [i % 50] * 300, 0) for i in range(400)]
    got = packed(spark, rows, shard_tokens=20_000)
    fill = Counter()
    for r in got:
        fill[r.container] += r.n_tokens
    assert len(got) == 400 and max(fill.values()) <= 1024 and len({c >> 32 for c in fill}) == 6


def test_fill_is_the_best_sum():
    rng = random.Random(8)
    for _ in range(300):
        sizes, space = [rng.randint(1, 40) for _ in range(rng.randint(0, 9))], rng.randint(1, 90)
        best = max(s for m in range(1 << len(sizes)) if (s := sum(x for i, x in enumerate(sizes) if m >> i & 1)) <= space)
        chosen = P.fill(sizes, space)
        assert sum(sizes[i] for i in chosen) == best and len(set(chosen)) == len(chosen)


def test_neighbours_share_words():
    docs = [[1, 2, 3, 4]] * 3 + [[7, 8, 9, 10]] * 3 + [[i] * 4 for i in range(20, 40)]
    item = np.repeat(np.arange(len(docs)), 4)
    s = P.Index(item, np.concatenate(docs), np.full(len(docs), 4)).scores(0)
    assert set(np.argsort(-s)[:3]) == {0, 1, 2} and s[3:].max() == 0
