import random

import pytest

from tidegraph.llm.chunks import boundaries, cuts, pieces


def greedy(text, limit, overlap, least=0.5):
    """The same cuts, one after the other."""
    out, done, start = [], 0, 0
    kinds = [set(b.tolist()) for b in boundaries(text)]
    while text:
        high = min(start + limit, len(text))
        if high == len(text):
            return [*out, (start, high)]
        end = high
        for k, kind in enumerate(kinds):
            low = max(done, start + int(limit * least)) if k < 2 else done
            if reach := [x for x in kind if low < x <= high]:
                end = max(reach)
                break
        out.append((start, end))
        done, start = end, max(end - overlap, 0)
    return out


def test_doubling_equals_greedy():
    rng = random.Random(1)
    for _ in range(600):
        texts = ["".join(rng.choice("abcde. \n" if rng.random() < 0.9 else "x。") for _ in range(rng.choice([0, 1, 5, 30, 100, 400]))) for _ in range(rng.randint(0, 5))]
        texts += ["z" * rng.randint(0, 300)] * rng.randint(0, 2)
        limit, overlap = rng.choice([10, 25, 50]), rng.choice([0, 3, 9])
        of, start, end = cuts(texts, limit, overlap)
        got = [[] for _ in texts]
        for i, a, b in zip(of, start, end, strict=True):
            got[i].append((int(a), int(b)))
        assert got == [greedy(t, limit, overlap) for t in texts]


def test_table(spark):
    long = "A sentence of some words. " * 400
    rows = [(1, long, 0), (1, long, 0), (2, None, 0), (3, "", 0), (4, "short", 0), (None, "x" * 4500, 0), (5, "𝐴" * 2001, 0)]
    df = spark.createDataFrame(rows, "k long, t string, start int")
    got = pieces(df, "k", "t").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r)
    assert len(by[4]) == 1 and 2 not in by and 3 not in by and len(by[None]) == 3 and len(by[5]) == 2
    one = sorted({(r.piece_no, r.start, r.end, r.piece) for r in by[1]})
    assert len(by[1]) == 2 * len(one) and one[0][1] == 0 and one[-1][2] == len(long)
    for (_, _, e, p), (_, s, _, _) in zip(one, one[1:], strict=False):
        assert s == e - 200 and len(p) <= 2000 and p.endswith(". ")
    assert all(r.piece == {1: long, 4: "short", None: "x" * 4500, 5: "𝐴" * 2001}[r.k][r.start : r.end] for r in got)
    assert pieces(df.limit(0), "k", "t").count() == 0
    with pytest.raises(ValueError):
        pieces(df, "k", "t", 10, 10)


def test_very_long_texts_without_breaks():
    of, start, end = cuts(["x" * 1_000_000])
    assert len(of) == 556 and end[-1] == 1_000_000 and (start[1:] == end[:-1] - 200).all()
