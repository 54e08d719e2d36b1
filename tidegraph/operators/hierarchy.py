"""Parent-child links as full hierarchies, by leaf peeling, Euler tours and parallel list ranking.

A group's rows name their parents by id. Per block of groups, on whole arrays:

1. Leaves are peeled off until none is left; what stays lies on a cycle.
2. With roots, orphans, self-parents and cycle rows as tops, the links form forests. Each tree's
   Euler tour is a linked list of one entry and one exit per row.
3. List ranking by pointer jumping gives every entry's and exit's place on its tour, in as many
   steps as the logarithm of the tour. The weighted rank (+1 entry, -1 exit) is the depth.
4. Rows in entry order put each row's descendants into one contiguous slice; ancestors are
   the rows whose intervals enclose its own, read off level by level.

Groups never cross blocks, and a task holds one block at a time: those groups that complete within
an Arrow batch, and what is left of the last one. Groups of more rows than a task should hold go
another way, with the same result: pointer doubling by joins, where no task ever holds a group or a row that many point to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.session import cut, cut_in_loop, hint_small, spread_join

#: Rows of a group from which it is solved by joins.
LARGE_ROWS, LARGE_GROUPS = 1_000_000, 100_000
KINDS = np.array(["root", "self", "cycle", "orphan", "ok", "below"], dtype=object)
ROOT, SELF, CYCLE, ORPHAN, OK, BELOW = range(6)


def rank_lists(after: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For linked lists whose last element points to itself: of each element the number of steps to
    the end, the sum of weights from it to the end (both included), and the end."""
    end = after == np.arange(len(after))
    steps, total = (~end).astype(np.int64), np.where(end, 0, weight)
    to = after.copy()
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return steps, total + weight[to], to
        steps, total = steps + steps[to], total + total[to]
        to = further


def solve(group: np.ndarray, ident: np.ndarray, parent: np.ndarray, has_parent: np.ndarray, is_root: np.ndarray) -> dict[str, np.ndarray]:
    """One block. group is non-decreasing, and ident increases within a group. Gives per row: kind,
    depth, top (row index), up (row index of the parent or -1), enter and leave."""
    n = len(group)
    kind = np.full(n, OK)
    if n == 0:
        none = np.zeros(0, np.int64)
        return {"kind": kind, "depth": none, "top": none, "up": none, "enter": none, "leave": none}
    # The row of each parent: binary search for (group, id), with ids made dense first.
    ids = np.unique(ident)
    place = np.searchsorted(ids, parent)
    known = has_parent & (place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == parent)
    code = group * (len(ids) + 1) + np.searchsorted(ids, ident)
    want = group * (len(ids) + 1) + np.where(known, place, len(ids))
    at = np.minimum(np.searchsorted(code, want), n - 1)
    up = np.where(known & (code[at] == want), at, -1)
    own = np.arange(n)
    kind[(up == -1) & ~is_root] = ORPHAN
    kind[(up == own) & ~is_root] = SELF
    kind[is_root] = ROOT
    up[kind != OK] = -1
    # 1. Peel leaves.
    children = np.bincount(up[up >= 0], minlength=n)
    alive = np.ones(n, bool)
    leaves = np.flatnonzero(children == 0)
    while len(leaves):
        alive[leaves] = False
        above = up[leaves]
        above = above[above >= 0]
        np.subtract.at(children, above, 1)
        above = np.unique(above)
        leaves = above[(children[above] == 0) & alive[above]]
    kind[alive] = CYCLE
    link = np.where(alive, -1, up)
    # 2. Euler tours: entry of row v is element 2v, its exit 2v + 1.
    after = np.empty(2 * n, np.int64)
    after[0::2] = 2 * own + 1
    after[1::2] = np.where(link >= 0, 2 * link + 1, 2 * own + 1)
    kids = np.flatnonzero(link >= 0)
    kids = kids[np.argsort(link[kids], kind="stable")]
    if len(kids):
        parents = link[kids]
        first = np.r_[True, parents[1:] != parents[:-1]]
        after[2 * parents[first]] = 2 * kids[first]
        brothers = np.flatnonzero(~first)
        after[2 * kids[brothers - 1] + 1] = 2 * kids[brothers]
    # 3. List ranking.
    weight = np.tile(np.array([1, -1], np.int64), n)
    steps, total, end = rank_lists(after, weight)
    top = end[0::2] // 2
    length = steps[2 * top]
    kind = np.where((kind == OK) & (kind[top] != ROOT), BELOW, kind)
    return {
        "kind": kind,
        "depth": -total[0::2],
        "top": top,
        "up": up,
        "link": link,
        "enter": length - steps[0::2],
        "leave": length - steps[1::2],
    }


def _slices(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.ListArray:
    """The lists values[start:start+count]."""
    offsets = np.r_[0, np.cumsum(count)]
    flat = np.repeat(start - offsets[:-1], count) + np.arange(offsets[-1])
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values[flat], pa.int32())).cast(pa.list_(pa.int32()))


def lists(got: dict[str, np.ndarray], ident: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """path, from the top to the row itself, and descendants by id."""
    top, link, depth = got["top"], got["link"], got["depth"]
    order = np.lexsort((got["enter"], top))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    below = (got["leave"] - got["enter"] - 1) // 2
    descendants = _sorted(_slices(ident[order], place + 1, below))
    offsets = np.r_[0, np.cumsum(depth + 1)]
    flat = np.empty(offsets[-1], np.int64)
    now, rows, at = np.arange(len(order)), np.arange(len(order)), offsets[1:] - 1
    while len(rows):
        flat[at] = ident[now]
        more = link[now] >= 0
        rows, now, at = rows[more], link[now[more]], at[more] - 1
    paths = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))
    return paths, descendants


def _sorted(lists_: pa.ListArray) -> pa.ListArray:
    flat, ends = lists_.values.to_numpy(zero_copy_only=False), lists_.offsets.to_numpy()
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    return pa.ListArray.from_arrays(lists_.offsets, pa.array(flat[np.lexsort((flat, owner))], lists_.type.value_type))


def hierarchies(
    df: DataFrame, group: list[str], ident: str, parent: str, is_root: Column, with_lists: bool = True, large_rows: int = LARGE_ROWS
) -> DataFrame:
    """For each row: kind, depth, top, n_below, and with ``with_lists`` path and descendants.

    kind is ``root`` or ``ok`` for rows that reach a root; else ``self`` (its own parent but no
    root), ``cycle`` (on a cycle of two or more), ``orphan`` (a null or unknown parent) or ``below``
    (leads to one of these). descendants come by id. depth, path and descendants count from the tree's top: a root, an
    orphan, a self-parent, or the cycle row it leads to; cycle rows themselves have depth 0.

    Repeated (group, id) rows count once: that with the smallest parent, nulls last. Rows with a
    null id are left out; a null in a group column is a value like any other. Extra columns are
    dropped. An empty table gives no rows.
    """
    names = {c: f"__g{i}" for i, c in enumerate(group)}
    base = df.select(
        *[F.col(c).alias(n) for c, n in names.items()],
        F.col(ident).cast("long").alias("__id"),
        F.col(parent).cast("long").alias("__up"),
        F.coalesce(is_root, F.lit(False)).alias("__root"),
    ).where(F.col("__id").isNotNull())
    g = list(names.values())
    # Large groups are few: at most rows / large_rows, so the list of them is small.
    large = base.groupBy(*g).agg(F.count("*").alias("n")).where(F.col("n") > large_rows)
    sizes = large.agg(F.count("*").alias("groups"), F.max("n").alias("n"), F.sum("n").alias("total")).first()
    if sizes.groups:
        large = hint_small(cut(large), LARGE_GROUPS, sizes.groups)
        same = _same(base, large, g)
        found = _by_joins(base.join(large, same, "left_semi"), g, sizes.n, sizes.total, with_lists)
        lists_ = ["path", "descendants"] * with_lists
        found = found.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("__id").cast("int").alias(ident), "kind", "depth", "top", "n_below", *lists_)
        base = base.join(large, same, "left_anti")
    # Partitioned by group, so the sort finds repeats next to each other; no second shuffle.
    placed = base.repartition(*g).sortWithinPartitions(*g, "__id", F.col("__up").asc_nulls_last(), F.desc("__root"))
    types = dict(base.dtypes)
    schema = ", ".join(
        [*(f"`{c}` {types[n]}" for c, n in names.items()), f"`{ident}` int", "kind string", "depth int", "top int", "n_below int"]
        + ["path array<int>", "descendants array<int>"] * with_lists
    )

    def block(t: pa.Table) -> pa.RecordBatch:
        columns = [t[n].combine_chunks() for n in g]
        n = t.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for c in columns:
            a, b = c[1:], c[:-1]
            differ = pc.fill_null(pc.not_equal(a, b), False)
            differ = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        ids = t["__id"].to_numpy()
        keep = np.flatnonzero(new | np.r_[True, ids[1:] != ids[:-1]])
        t = t.take(pa.array(keep))
        group_no, ids = np.cumsum(new)[keep], ids[keep]
        has = pc.is_valid(t["__up"]).to_numpy(zero_copy_only=False)
        got = solve(group_no, ids, pc.fill_null(t["__up"], 0).to_numpy(), has, t["__root"].to_numpy(zero_copy_only=False))
        out = [t[n].combine_chunks() for n in g] + [
            pa.array(ids, pa.int32()),
            pa.array(KINDS[got["kind"]], pa.string()),
            pa.array(got["depth"], pa.int32()),
            pa.array(ids[got["top"]], pa.int32()),
            pa.array((got["leave"] - got["enter"] - 1) // 2, pa.int32()),
        ]
        if with_lists:
            out += lists(got, ids)
        return pa.RecordBatch.from_arrays(out, names=[*group, ident, "kind", "depth", "top", "n_below"] + ["path", "descendants"] * with_lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            # The last group may go on in the next batch: rows equal to the last in all group columns.
            last = pa.array([True] * b.num_rows)
            for n in g:
                v = b[n][-1]
                same = pc.is_null(b[n]) if not v.is_valid else pc.fill_null(pc.equal(b[n], v), False)
                last = pc.and_(last, same)
            cut = b.num_rows - pc.sum(last).as_py()
            if cut == 0 and held and not _continues(held[-1], b, g):
                yield block(pa.Table.from_batches(held))
                held = []
            if cut:
                held.append(b.slice(0, cut))
                yield block(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(cut))
        if held:
            yield block(pa.Table.from_batches(held))

    blocks = placed.mapInArrow(run, schema)
    return blocks.unionByName(found) if sizes.groups else blocks


def _same(a: DataFrame, b: DataFrame, g: list[str]) -> Column:
    out = F.lit(True)
    for c in g:
        out = out & F.equal_null(a[c], b[c])
    return out


def _by_joins(base: DataFrame, g: list[str], most: int, total: int, with_lists: bool) -> DataFrame:
    """The same columns by pointer doubling: every round joins each row with what its pointer points
    to, so that after k rounds it has seen 2^k rows above it. Rows are spread by group and id."""
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in g])  # one column to join by; groups are few
    first = base.groupBy(key.alias("k"), "__id").agg(
        F.min(F.struct(F.col("__up").isNull(), "__up", (~F.col("__root")).alias("no"))).alias("x"), *[F.first(c).alias(c) for c in g]
    )
    rows = first.select("k", "__id", *g, F.col("x.__up").alias("up"), (~F.col("x.no")).alias("root"))
    there = rows.select("k", F.col("__id").alias("up"), F.lit(True).alias("there"))
    rows = cut(
        rows.join(there, ["k", "up"], "left").select(
            "k", "__id", *g, "up",
            F.when(F.col("root"), "root").when(F.col("there").isNull(), "orphan").when(F.col("up") == F.col("__id"), "self").alias("own"),
        )
    )
    # Rows that lead to no end are on cycles or below them; where they are after more steps than there are rows is on one.
    walk = rows.select("k", "__id", F.when(F.col("own").isNull(), F.col("up")).otherwise(F.col("__id")).alias("to"))
    # Pointers end at few rows, or pass through few; such rows are met apart.
    for _ in range(math.ceil(math.log2(most + 1))):
        step = walk.select("k", F.col("__id").alias("to"), F.col("to").alias("next"))
        walk = cut_in_loop(spread_join(walk, step, ["k", "to"], total).select("k", "__id", F.col("next").alias("to")))
    ends = rows.where(F.col("own").isNotNull()).select("k", F.col("__id").alias("to"))
    cycle = walk.join(ends, ["k", "to"], "left_anti").select("k", F.col("to").alias("__id"), F.lit(True).alias("cycle")).distinct()
    rows = cut(
        rows.join(cycle, ["k", "__id"], "left").select("k", "__id", *g, "up", F.coalesce("own", F.when(F.col("cycle"), "cycle")).alias("own"))
    )
    # Now every chain ends. steps: how far ``to`` is above the row; n: rows at most that far below it.
    state = rows.select(
        "k", "__id", F.when(F.col("own").isNull(), F.col("up")).otherwise(F.col("__id")).alias("to"), F.col("own").isNull().cast("int").alias("steps"),
        F.lit(1).cast("long").alias("n"), *[F.when(F.col("own").isNull(), F.array("__id")).otherwise(F.array().cast("array<bigint>")).alias("seg")] * with_lists,
    )
    reach = 1
    while not state.where(F.col("steps") == reach).isEmpty():
        below = state.where(F.col("steps") == reach).groupBy("k", F.col("to").alias("__id")).agg(F.sum("n").alias("more"))
        ahead = state.select("k", F.col("__id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("s2"), *[F.col("seg").alias("seg2")] * with_lists)
        state = cut_in_loop(
            spread_join(state, ahead, ["k", "to"], total).join(below, ["k", "__id"], "left").select(
                "k", "__id", F.col("next").alias("to"), (F.col("steps") + F.col("s2")).alias("steps"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"),
                *[F.concat("seg2", "seg").alias("seg")] * with_lists,
            )
        )
        reach *= 2
    tops = rows.select("k", F.col("__id").alias("to"), F.col("own").alias("end"))
    out = state.join(tops, ["k", "to"]).join(rows.drop("up"), ["k", "__id"]).select(
        "k", "__id", *g,
        F.coalesce("own", F.when(F.col("end") == "root", "ok").otherwise("below")).alias("kind"),
        F.col("steps").alias("depth"), F.col("to").cast("int").alias("top"), (F.col("n") - 1).cast("int").alias("n_below"),
        *[F.concat(F.array("to"), "seg").cast("array<int>").alias("path")] * with_lists,
    )
    if not with_lists:
        return out
    out = cut(out)
    above = out.select("k", F.col("__id").alias("d"), F.explode(F.slice("path", 1, F.col("depth"))).alias("a"))
    lists_ = above.groupBy("k", F.col("a").cast("long").alias("__id")).agg(F.sort_array(F.collect_list(F.col("d").cast("int"))).alias("descendants"))
    return out.join(lists_, ["k", "__id"], "left").withColumn("descendants", F.coalesce("descendants", F.array().cast("array<int>")))


def _continues(a: pa.RecordBatch, b: pa.RecordBatch, columns: list[str]) -> bool:
    return all(a[c][-1].as_py() == b[c][0].as_py() for c in columns)
