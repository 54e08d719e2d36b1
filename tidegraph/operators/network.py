"""Graphs from extracts, their statistics, composites and rankings.

All graphs of a corpus are one pair of tables keyed by graph_id, so one job handles every document.
Statistics on pairs (reciprocity, transitivity, centralization, density) take distinct ordered pairs,
however many edges a pair has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.session import cut, cut_in_loop, hint_small, spread_join

G = "graph_id"
#: Pairs of a graph up to which its communities are computed in one task; larger graphs go by joins, with the same result.
TASK_PAIRS = 1_000_000
#: Graphs up to which a row per graph is broadcast.
SMALL_GRAPHS = 200_000
#: Shortest paths: vertices times pairs from which a graph's sources are parted, most parts, and cells of sources times vertices held at once.
PART_WORK, MOST_PARTS, CELLS = 20_000_000, 64, 100_000
FORMATS = ("igraph", "network")


@dataclass
class Graph:
    """vertices (graph_id, entity_name, entity_type, num_appearances), edges (graph_id, source, target, ...)."""

    vertices: DataFrame
    edges: DataFrame
    self_loops: bool = True
    collapsed: bool = False


def graph(nodes: DataFrame, edges: DataFrame, keep_isolates: bool = True, collapse_edges: bool = False, self_loops: bool = True, export_format: str = "network") -> Graph:
    """Nodes and complete edges as graphs. Ends that are no node are left out with their edges.

    nodes: (graph_id, entity_name, ...), one row per name; edges: (graph_id, source, target, ...).
    ``collapse_edges`` drops attributes and counts parallel edges as weight. Null ends drop the edge.
    """
    if export_format not in FORMATS:
        raise ValueError(f"export_format must be one of {FORMATS}")
    for flag in (keep_isolates, collapse_edges, self_loops):
        if not isinstance(flag, bool):
            raise ValueError("keep_isolates, collapse_edges and self_loops must be single logical values")
    e = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    names = nodes.where(F.col("entity_name").isNotNull())
    for end in ("source", "target"):
        e = e.join(names.select(G, F.col("entity_name").alias(end)), [G, end], "left_semi")
    if not self_loops:
        e = e.where(F.col("source") != F.col("target"))
    if collapse_edges:
        e = e.groupBy(G, "source", "target").agg(F.count("*").alias("weight"))
    if not keep_isolates:
        ends = e.select(G, F.explode(F.array("source", "target")).alias("entity_name")).distinct()
        names = names.join(ends, [G, "entity_name"], "left_semi")
    return Graph(names, e, self_loops, collapse_edges)


def pairs(g: Graph) -> DataFrame:
    """Distinct ordered pairs with their number of edges."""
    n = F.sum("weight") if g.collapsed else F.count("*")
    return g.edges.groupBy(G, "source", "target").agg(n.alias("weight"))


def sizes(g: Graph) -> DataFrame:
    n = g.vertices.groupBy(G).agg(F.count("*").alias("num_nodes"))
    return n.join(g.edges.groupBy(G).agg(F.count("*").alias("num_edges")), G, "left").select(G, "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges"))


def degrees(g: Graph, weighted: bool = False) -> DataFrame:
    """in and out of every vertex, zeros included; ``weighted`` sums weights. Ends are counted per
    map task before they shuffle, so hubs don't gather."""
    w = F.col("weight") if weighted and g.collapsed else F.lit(1)
    ends = g.edges.select(
        G,
        F.explode(
            F.array(
                F.struct(F.col("source").alias("entity_name"), F.lit(0).cast("long").alias("i"), w.cast("long").alias("o")),
                F.struct(F.col("target").alias("entity_name"), w.cast("long").alias("i"), F.lit(0).cast("long").alias("o")),
            )
        ).alias("x"),
    ).select(G, "x.*")
    sums = ends.groupBy(G, "entity_name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("long")
    return g.vertices.select(G, "entity_name").join(sums, [G, "entity_name"], "left").select(
        G, "entity_name", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree")
    )


def degree_stats(g: Graph, name: str = "degree", weighted: bool = False) -> DataFrame:
    """Mean and median of in and out over all vertices."""
    return degrees(g, weighted).groupBy(G).agg(
        F.avg("in_degree").alias(f"mean_in_{name}"),
        F.avg("out_degree").alias(f"mean_out_{name}"),
        F.median("in_degree").alias(f"median_in_{name}"),
        F.median("out_degree").alias(f"median_out_{name}"),
    )


def density(g: Graph) -> DataFrame:
    """Distinct pairs over possible ones; loops count on both sides if the graph may have them."""
    n = F.col("num_nodes")
    possible = n * (n if g.self_loops else n - 1)
    p = pairs(g).groupBy(G).agg(F.count("*").alias("p"))
    return sizes(g).join(p, G, "left").select(G, F.try_divide(F.coalesce("p", F.lit(0)), possible).alias("density"))


def reciprocity(g: Graph) -> DataFrame:
    """Share of ordered pairs whose reverse is there; loops count only if the graph may have them."""
    p = pairs(g).select(G, "source", "target")
    back = p.select(G, F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("back"))
    return p.join(back, [G, "source", "target"], "left").groupBy(G).agg(F.avg(F.coalesce("back", F.lit(False)).cast("int")).alias("reciprocity"))


def homophily(g: Graph) -> DataFrame:
    """Share of edges between vertices of one type; edges with an unknown type don't count."""
    t = g.vertices.select(G, "entity_name", "entity_type")
    p = (
        pairs(g)
        .join(t.select(G, F.col("entity_name").alias("source"), F.col("entity_type").alias("a")), [G, "source"])
        .join(t.select(G, F.col("entity_name").alias("target"), F.col("entity_type").alias("b")), [G, "target"])
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    w = F.lit(1) if g.collapsed else F.col("weight")
    return p.groupBy(G).agg((F.sum(F.when(F.col("a") == F.col("b"), w).otherwise(0)) / F.sum(w)).alias("pct_entitytype_homophily"))


def centralization(g: Graph) -> DataFrame:
    """Freeman's centralization of total degree on distinct pairs: the sum of differences from the
    highest degree, over the greatest possible one, (n-1)(2(n-1)-2+d), d being 1 with loops."""
    simple = Graph(g.vertices, pairs(g), g.self_loops, True)
    d = degrees(simple).select(G, (F.col("in_degree") + F.col("out_degree")).alias("d"))
    s = d.groupBy(G).agg(F.count("*").alias("n"), F.max("d").alias("m"), F.sum("d").alias("s"))
    n = F.col("n")
    most = (n - 1) * (2 * (n - 1) - 2 + (1 if g.self_loops else 0))
    return s.select(G, F.try_divide(F.col("m") * n - F.col("s"), most).alias("centralization"))


def triangles(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, vertices, triangles). pairs (a, b, m): m is 1 for a to b, 2 for b to a, 3 for both; vertices (v, i, o, d): pairs in
    and out, and partners. A triangle is found once, from its vertex of lowest degree, whose pairs of
    neighbours are few even where a hub has very many: (low, a, b), ua and ub from low, au and bu to it, m of a and b."""
    p = pairs(g).where(F.col("source") != F.col("target")).select(G, "source", "target")
    und = (
        p.select(
            G,
            F.least("source", "target").alias("a"),
            F.greatest("source", "target").alias("b"),
            F.when(F.col("source") < F.col("target"), 1).otherwise(2).alias("m"),
        )
        .groupBy(G, "a", "b")
        .agg(F.sum("m").alias("m"))
    )
    und = cut(und)
    flow = (
        und.select(
            G,
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("v"), (F.col("m") != 2).cast("long").alias("o"), (F.col("m") != 1).cast("long").alias("i")),
                    F.struct(F.col("b").alias("v"), (F.col("m") != 1).cast("long").alias("o"), (F.col("m") != 2).cast("long").alias("i")),
                )
            ).alias("x"),
        )
        .select(G, "x.*")
        .groupBy(G, "v")
        .agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.count("*").alias("d"))
    )
    da, db = flow.select(G, F.col("v").alias("a"), F.col("d").alias("da")), flow.select(G, F.col("v").alias("b"), F.col("d").alias("db"))
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    # out: the pair's bit from low to high; back: from high to low.
    o = und.join(da, [G, "a"]).join(db, [G, "b"]).select(
        G,
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("low"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("high"),
        F.when(first, F.col("m") != 2).otherwise(F.col("m") != 1).alias("out"),
        F.when(first, F.col("m") != 1).otherwise(F.col("m") != 2).alias("back"),
    )
    x = o.select(G, "low", F.col("high").alias("a"), F.col("out").alias("ua"), F.col("back").alias("au"))
    y = o.select(G, "low", F.col("high").alias("b"), F.col("out").alias("ub"), F.col("back").alias("bu"))
    return und, flow, x.join(y, [G, "low"]).where(F.col("a") < F.col("b")).join(und, [G, "a", "b"])


def transitivity(g: Graph) -> DataFrame:
    """Share of ordered paths i, j, k of three vertices that i leads to k as well. Paths are counted from degrees, closed ones
    per triangle."""
    und, flow, t = triangles(g)
    mutual = und.groupBy(G).agg((2 * F.count_if(F.col("m") == 3)).alias("mutual"))
    paths = flow.groupBy(G).agg(F.sum(F.col("i") * F.col("o")).alias("through")).join(mutual, G).select(G, (F.col("through") - F.col("mutual")).alias("paths"))
    ab, ba = F.col("m") != 2, F.col("m") != 1
    ua, au, ub, bu = (F.col(c) for c in ("ua", "au", "ub", "bu"))
    closed = [ua & ab & ub, ub & ba & ua, au & ub & ab, ab & bu & au, bu & ua & ba, ba & au & bu]
    total = closed[0].cast("int")
    for c in closed[1:]:
        total = total + c.cast("int")
    hits = t.groupBy(G).agg(F.sum(total).alias("closed"))
    return paths.join(hits, G, "left").select(G, F.try_divide(F.coalesce("closed", F.lit(0)), F.col("paths")).alias("transitivity"))


def components(g: Graph) -> DataFrame:
    """(graph_id, entity_name, component): weak components, named by their smallest vertex.

    Every round takes the smallest label around and then the label of the label, so that the number of
    rounds is about the logarithm of the longest chain. Only labels that changed are passed on: a
    vertex whose label stayed has told its neighbours, and a label whose own label stayed leads nowhere, so what all
    rows of a giant component share takes part in no join.
    """
    e = g.edges.where(F.col("source") != F.col("target")).select(G, "source", "target").distinct()
    both = cut_in_loop(e.select(G, F.col("source").alias("x"), F.col("target").alias("y")).union(e.select(G, "target", "source")).distinct())
    labels = cut_in_loop(g.vertices.select(G, F.col("entity_name").alias("x"), F.col("entity_name").alias("label")))
    news = labels
    while True:
        told = news.select(G, F.col("x").alias("y"), F.col("label").alias("near"))
        near = spread_join(both, told, [G, "y"]).where(F.col("near").isNotNull()).groupBy(G, "x").agg(F.min("near").alias("near"))
        low = cut_in_loop(labels.join(near, [G, "x"], "left").select(G, "x", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")))
        jump = cut_in_loop(low.where(F.col("label") != F.col("x")).select(G, F.col("x").alias("label"), F.col("label").alias("further")))
        labels2 = cut_in_loop(spread_join(low, jump, [G, "label"]).select(G, "x", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = labels2.select(G, "x", "label")
        news = labels2.where(F.col("old") != F.col("label")).select(G, "x", "label")
        if news.isEmpty():
            return labels.select(G, F.col("x").alias("entity_name"), F.col("label").alias("component"))


def connectedness(g: Graph) -> DataFrame:
    """Share of ordered pairs of vertices that some chain of edges joins."""
    c = components(g).groupBy(G, "component").agg(F.count("*").alias("c"))
    s = c.groupBy(G).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("joined"), F.sum("c").alias("n"))
    return s.select(G, F.try_divide("joined", F.col("n") * (F.col("n") - 1)).alias("connectedness"))


def tense_shares(g: Graph) -> DataFrame:
    tense = F.col("head_verb_tense")
    return g.edges.groupBy(G).agg(*[F.avg((tense == t).cast("int")).alias(f"percent_{t.lower()}") for t in ("VBN", "VBG", "VBP", "VBD", "VB", "VBZ")])


def undirected(g: Graph) -> DataFrame:
    """Weights summed over both directions, a <= b."""
    return pairs(g).groupBy(G, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("w"))


def moves(edges: list[tuple[str, str, int]]) -> dict[str, str]:
    """Communities of one weighted undirected graph, without chance: the rounds of ``communities`` on dictionaries."""
    member = {v: v for a, b, _ in edges for v in (a, b)}
    level = edges
    while True:
        near: dict[str, dict[str, int]] = {}
        loop: dict[str, int] = {}
        for a, b, w in level:
            if a == b:
                loop[a] = loop.get(a, 0) + w
                near.setdefault(a, {})
            else:
                near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0) + w
                near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0) + w
        k = {v: sum(n.values()) + 2 * loop.get(v, 0) for v, n in near.items()}
        m2 = sum(k.values())
        com, q = {v: v for v in near}, m2 * 2 * sum(loop.values()) - sum(x * x for x in k.values())
        down, idle, moved = True, 0, False
        while idle < 2:
            total: dict[str, int] = {}
            for v, c in com.items():
                total[c] = total.get(c, 0) + k[v]
            new = dict(com)
            for v, n in near.items():
                links: dict[str, int] = {}
                for u, w in n.items():
                    links[com[u]] = links.get(com[u], 0) + w
                stay = links.get(com[v], 0) * m2 - (total[com[v]] - k[v]) * k[v]
                ways = [(stay - w * m2 + total[c] * k[v], c) for c, w in links.items() if (c < com[v] if down else c > com[v])]
                if ways and min(ways)[0] < 0:
                    new[v] = min(ways)[1]
            total = {}
            for v, c in new.items():
                total[c] = total.get(c, 0) + k[v]
            q2 = m2 * (2 * sum(loop.values()) + sum(w for v, n in near.items() for u, w in n.items() if new[u] == new[v])) - sum(x * x for x in total.values())
            idle = 0 if q2 > q else idle + 1
            if q2 > q:
                com, q, moved = new, q2, True
            down = not down
        member = {v: com[c] for v, c in member.items()}
        if not moved:
            least: dict[str, str] = {}
            for v, c in member.items():
                least[c] = min(v, least.get(c, v))
            return {v: least[c] for v, c in member.items()}
        merged: dict[tuple[str, str], int] = {}
        for a, b, w in level:
            key = (min(com[a], com[b]), max(com[a], com[b]))
            merged[key] = merged.get(key, 0) + w
        level = [(a, b, w) for (a, b), w in merged.items()]


def communities(g: Graph, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(graph_id, entity_name, community), named by its smallest vertex. Isolates are each a community.

    Louvain's levels with moves in rounds: all vertices of a round move at once to the community around that gains most
    modularity, of equal ones the smallest; to smaller names only in one round and to larger ones in the next, so that two never
    swap. A round counts if modularity rises, in whole numbers; after two that don't, communities become the
    vertices of the next level, and a level without moves ends it. Graphs of up to ``task_pairs`` pairs run
    in a task, larger ones by joins: where a graph is computed makes no difference to its communities.
    """
    u = cut(undirected(g))
    sizes_ = u.groupBy(G).agg((F.count("*") > task_pairs).alias("large"))
    tagged = u.join(sizes_, G)
    kind = dict(u.dtypes)[G]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = moves(list(zip(pdf["a"], pdf["b"], pdf["w"].astype(int).tolist(), strict=True)))
        return pd.DataFrame({G: key[0], "entity_name": list(got), "community": list(got.values())})

    found = tagged.where(~F.col("large")).select(G, "a", "b", "w").groupBy(G).applyInPandas(one, f"{G} {kind}, entity_name string, community string")
    large = tagged.where("large").select(G, "a", "b", "w")
    if not large.isEmpty():
        found = found.unionByName(_moves_by_joins(large))
    return g.vertices.select(G, "entity_name").join(found, [G, "entity_name"], "left").select(G, "entity_name", F.coalesce("community", "entity_name").alias("community"))


def _moves_by_joins(u: DataFrame) -> DataFrame:
    """The rounds of ``moves`` for all graphs at once. A hub's or a large community's one row is met in several places."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    level, member = u, None
    while True:
        both = cut_in_loop(level.where("a <> b").select(G, F.col("a").alias("x"), F.col("b").alias("y"), "w").union(level.where("a <> b").select(G, "b", "a", "w")))
        ends = both.select(G, F.col("x").alias("v"), "w").union(level.where("a = b").select(G, "a", 2 * F.col("w")))
        k = cut_in_loop(ends.groupBy(G, "v").agg(F.sum("w").alias("k")))
        size = k.count()  # no table by vertex or community has more rows at this level
        m2 = k.groupBy(G).agg(F.sum("k").alias("m2"), F.sum(big("k") * big("k")).alias("kk"))
        loops = level.where("a = b").groupBy(G).agg((2 * F.sum("w")).alias("l2"))
        state = cut_in_loop(m2.join(loops, G, "left").na.fill(0, ["l2"]).select(G, "m2", "l2", (big("m2") * big("l2") - F.col("kk")).alias("q"), F.lit(0).alias("idle"), F.lit(False).alias("moved")))
        com, down = k.select(G, "v", "k", F.col("v").alias("c")), True
        while not state.where("idle < 2").isEmpty():
            now = com.join(hint_small(state.select(G, "m2"), SMALL_GRAPHS, 0 if size <= SMALL_GRAPHS else None), G)
            total = now.groupBy(G, "c").agg(F.sum("k").alias("total"))
            near = spread_join(both, now.select(G, F.col("v").alias("y"), "c"), [G, "y"], size)
            links = near.groupBy(G, F.col("x").alias("v"), "c").agg(F.sum("w").alias("links"))
            here = spread_join(now, total.select(G, "c", F.col("total").alias("own")), [G, "c"], size).withColumnRenamed("c", "old")
            ways = spread_join(links, total, [G, "c"], size).join(here, [G, "v"])
            stay = F.coalesce(F.max(F.when(F.col("c") == F.col("old"), F.col("links"))), F.lit(0))
            # What a community costs against staying, but for the links that stay, which are the same for all of a vertex.
            cost = big("total") * big("k") - (big("own") - big("k")) * big("k") - big("links") * big("m2")
            turn = F.col("c") < F.col("old") if down else F.col("c") > F.col("old")
            best = ways.groupBy(G, "v").agg(
                (stay.cast("decimal(38,0)") * F.max(big("m2"))).alias("stay"), F.min(F.when(turn, F.struct(cost.alias("cost"), "c"))).alias("x")
            ).where(F.col("stay") + F.col("x.cost") < 0).select(G, "v", F.col("x.c").alias("new"))
            new = cut_in_loop(com.join(best, [G, "v"], "left").select(G, "v", "k", "c", F.coalesce("new", "c").alias("new")))
            squares = new.groupBy(G, "new").agg(F.sum("k").alias("k")).groupBy(G).agg(F.sum(big("k") * big("k")).alias("kk"))
            named = new.select(G, F.col("v").alias("y"), F.col("new").alias("cy"))
            inside = (
                spread_join(spread_join(both, named, [G, "y"], size), named.toDF(G, "x", "cx"), [G, "x"], size)
                .where("cx = cy").groupBy(G).agg(F.sum("w").alias("inside"))
            )
            q2 = big("m2") * (big("l2") + F.coalesce(big("inside"), F.lit(0))) - F.col("kk")
            tried = state.join(squares, G).join(inside, G, "left").withColumn("q2", q2).withColumn("up", F.col("q2") > F.col("q"))
            state = cut_in_loop(tried.select(G, "m2", "l2", F.when(F.col("up"), F.col("q2")).otherwise(F.col("q")).alias("q"), F.when(F.col("up"), 0).otherwise(F.col("idle") + 1).alias("idle"), (F.col("moved") | F.col("up")).alias("moved"), "up"))
            com = new.join(hint_small(state.select(G, "up"), SMALL_GRAPHS, 0 if size <= SMALL_GRAPHS else None), G).select(G, "v", "k", F.when(F.col("up"), F.col("new")).otherwise(F.col("c")).alias("c"))
            down = not down
        com = cut_in_loop(com)
        step = com.select(G, F.col("v").alias("at"), "c")
        member = cut_in_loop(
            com.select(G, "v", "c") if member is None
            else spread_join(member.withColumnRenamed("c", "at"), step, [G, "at"], size).select(G, "v", F.coalesce("c", "at").alias("c"))
        )
        if state.where("moved").isEmpty():
            least = member.groupBy(G, "c").agg(F.min("v").alias("community"))
            return spread_join(member, least, [G, "c"], size).select(G, F.col("v").alias("entity_name"), "community")
        ca, cb = com.select(G, F.col("v").alias("a"), F.col("c").alias("ca")), com.select(G, F.col("v").alias("b"), F.col("c").alias("cb"))
        level = cut_in_loop(spread_join(spread_join(level, ca, [G, "a"], size), cb, [G, "b"], size).groupBy(G, F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))


def modularity(g: Graph, found: DataFrame) -> DataFrame:
    """modularity and num_communities of a partition of the undirected weighted graph."""
    u = undirected(g)
    a = found.select(G, F.col("entity_name").alias("a"), F.col("community").alias("ca"))
    b = found.select(G, F.col("entity_name").alias("b"), F.col("community").alias("cb"))
    e = u.join(a, [G, "a"]).join(b, [G, "b"])
    inside = e.groupBy(G).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)).alias("inside"), F.sum("w").alias("m"))
    ends = e.select(G, F.explode(F.array(F.struct(F.col("ca").alias("c"), "w"), F.struct(F.col("cb").alias("c"), "w"))).alias("x")).select(G, "x.*")
    strength = ends.groupBy(G, "c").agg(F.sum("w").alias("k")).groupBy(G).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    count = found.groupBy(G, "community").agg(F.lit(1).alias("one")).groupBy(G).agg(F.count("*").alias("num_communities"))
    return count.join(inside, G, "left").join(strength, G, "left").select(
        G, F.try_subtract(F.col("inside") / F.col("m"), F.col("kk") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"), "num_communities"
    )


def statistics(g: Graph) -> DataFrame:
    """One row per graph with all statistics of its kind: eleven common ones, and eight for weighted
    or multiplex graphs."""
    g = Graph(cut(g.vertices), cut(g.edges), g.self_loops, g.collapsed)
    parts = [connectedness(g), centralization(g), transitivity(g), homophily(g), reciprocity(g), degree_stats(g), modularity(g, communities(g))]
    if g.collapsed:
        parts += [density(g), g.edges.groupBy(G).agg(F.avg("weight").alias("mean_edge_weight")), degree_stats(g, "strength", True)]
    else:
        parts.append(tense_shares(g))
    out = sizes(g)
    for p in parts:
        out = out.join(p, G, "left")
    return out


def combine(vertices: DataFrame, edges: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """The composite of all graphs. A name's attributes are those of the graph where it appears most
    (of equals the smallest graph_id); num_graphs_in says in how many it is. ``weighted`` drops edge
    attributes and counts every input edge once; loops stay."""
    if mode not in ("multiplex", "weighted"):
        raise ValueError("mode must be 'multiplex' or 'weighted'")
    # min_by is a partial aggregate: one row per name and map task is shuffled, not every row.
    rank = F.struct(-F.coalesce("num_appearances", F.lit(0)), G, F.coalesce("entity_type", F.lit("")))
    nodes = vertices.groupBy("entity_name").agg(
        F.min_by(F.struct("entity_type", "num_appearances"), rank).alias("x"), F.count("*").alias("num_graphs_in")
    ).select("entity_name", "x.entity_type", "x.num_appearances", "num_graphs_in")
    if mode == "weighted":
        return nodes, edges.groupBy("source", "target").agg(F.count("*").alias("weight"))
    return nodes, edges


def _shares(counts: DataFrame, key: str, n_graphs: Column) -> DataFrame:
    """Each key's share of its graph's counts, averaged. A graph's total is a partial aggregate and
    comes back by join, so a graph of very many rows isn't one task's."""
    counts = cut(counts)
    totals = counts.groupBy(G).agg(F.sum("n").alias("total"))
    share = F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0))  # a graph without edges has no shares
    shares = counts.join(hint_small(totals, SMALL_GRAPHS), G).select(key, share.alias("share"))
    return shares.groupBy(key).agg((F.sum("share") / n_graphs).alias("avg_share"))


def top_entities(g: Graph) -> DataFrame:
    """(entity_name, avg_share): degree over the graph's sum of degrees, averaged over all graphs,
    0 where absent; names need a letter. Sort by share, then name, for a ranking."""
    d = degrees(g).select(G, "entity_name", (F.col("in_degree") + F.col("out_degree")).alias("n"))
    n_graphs = F.lit(d.select(F.count_distinct(G)).scalar())
    return _shares(d, "entity_name", n_graphs).where(F.col("entity_name").rlike("[A-Za-z]"))


def top_lemmas(g: Graph) -> DataFrame:
    """(head_verb_lemma, avg_share): the same for the lemmas of edges."""
    c = g.edges.where(F.col("head_verb_lemma").isNotNull()).groupBy(G, "head_verb_lemma").agg(F.count("*").alias("n"))
    n_graphs = F.lit(g.vertices.select(F.count_distinct(G)).scalar())
    return _shares(c, "head_verb_lemma", n_graphs)


def node_metrics(g: Graph) -> DataFrame:
    """Degrees of every vertex and the share of its partners that are mutual."""
    p = pairs(g).where(F.col("source") != F.col("target")).select(G, "source", "target")
    back = p.select(G, F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).alias("back"))
    partner = p.union(p.select(G, "target", "source")).distinct().join(p.join(back, [G, "source", "target"]), [G, "source", "target"], "left")
    mutual = partner.groupBy(G, F.col("source").alias("entity_name")).agg(F.avg(F.coalesce("back", F.lit(0))).alias("mutual_share"), F.count("*").alias("n_partners"))
    return degrees(g).join(mutual, [G, "entity_name"], "left").select(
        G, "entity_name", "in_degree", "out_degree", F.coalesce("n_partners", F.lit(0)).alias("n_partners"), "mutual_share"
    )


def overlap(vertices: DataFrame) -> DataFrame:
    """For names in several graphs: how many graphs have as many of them. (n_graphs, n_names)"""
    per_name = vertices.select(G, "entity_name").distinct().groupBy("entity_name").agg(F.count("*").alias("n_graphs"))
    return per_name.groupBy("n_graphs").agg(F.count("*").alias("n_names"))


def top_features(graphs: Graph | str, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """The rankings (entities, lemmas), each sorted by share and then name, of graphs or of the folder they were written to."""
    g = read_graph(spark, graphs) if isinstance(graphs, str) else graphs
    return top_entities(g).orderBy(F.desc("avg_share"), "entity_name"), top_lemmas(g).orderBy(F.desc("avg_share"), "head_verb_lemma")


def write_graph(g: Graph, path: str, overwrite: bool = True) -> None:
    """Three parquet folders under one path: vertices, edges, and the two flags."""
    mode = "overwrite" if overwrite else "errorifexists"
    g.vertices.write.mode(mode).parquet(f"{path}/vertices")
    g.edges.write.mode(mode).parquet(f"{path}/edges")
    g.vertices.sparkSession.createDataFrame([(g.self_loops, g.collapsed)], "self_loops boolean, collapsed boolean").coalesce(1).write.mode(mode).parquet(f"{path}/flags")


def read_graph(spark: SparkSession, path: str) -> Graph:
    flags = spark.read.parquet(f"{path}/flags").first()
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), flags.self_loops, flags.collapsed)


def clustering(g: Graph) -> DataFrame:
    """(graph_id, entity_name, clustering): of the directed triangles that a vertex's pairs could make, the share there is:
    over d(d-1)-2r, d being its pairs in and out and r its mutual partners; 0 where none is possible. Loops don't count."""
    und, flow, t = triangles(g)
    one = lambda *cs: sum((F.col(c).cast("long") for c in cs[1:]), F.col(cs[0]).cast("long"))
    n = one("ua", "au") * one("ub", "bu") * F.when(F.col("m") == 3, 2).otherwise(1)
    at = t.select(G, F.explode(F.array("low", "a", "b")).alias("v"), n.alias("n")).groupBy(G, "v").agg(F.sum("n").alias("n"))
    mutual = und.where("m = 3").select(G, F.explode(F.array("a", "b")).alias("v")).groupBy(G, "v").agg(F.count("*").alias("r"))
    d = F.col("i") + F.col("o")
    share = flow.join(at, [G, "v"], "left").join(mutual, [G, "v"], "left").select(
        G, F.col("v").alias("entity_name"), F.try_divide(F.coalesce("n", F.lit(0)), d * (d - 1) - 2 * F.coalesce("r", F.lit(0))).alias("clustering")
    )
    return g.vertices.select(G, "entity_name").join(share, [G, "entity_name"], "left").select(G, "entity_name", F.coalesce("clustering", F.lit(0.0)).alias("clustering"))


def _added(at: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums): the weights, none below 0, summed by place; over all places at once unless few of them are meant."""
    if len(at) * 16 < size:
        places, inverse = np.unique(at, return_inverse=True)
        return places, np.bincount(inverse, weights=weights)
    total = np.bincount(at, weights=weights, minlength=size)
    places = np.flatnonzero(total)
    return places, total[places]


def reach(x: np.ndarray, y: np.ndarray, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vertices, their sums of one over distance, vertices, what paths between ordered pairs of others lead through them) of a graph
    without directions, given as its distinct pairs x, y without loops; both summed over the sources of a part of the graph.

    Vertices of one partner are folded into it: they see what it sees a step later, and what is between is counted by
    weights. From the others Brandes' steps run for as many sources together as fill ``CELLS`` cells, so the
    memory is that of the pairs, and pairs of vertices are nowhere kept.
    """
    names, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    degree = np.bincount(ends, minlength=len(names))
    leaf = np.zeros(len(names), bool)
    leaf[a[(degree[a] == 1) & (degree[b] > 1)]] = leaf[b[(degree[b] == 1) & (degree[a] > 1)]] = True
    to_core = np.cumsum(~leaf) - 1
    core, n = np.flatnonzero(~leaf), int((~leaf).sum())
    folded = np.concatenate([a[leaf[b]], b[leaf[a]]]), np.concatenate([b[leaf[b]], a[leaf[a]]])  # (core vertex, its leaf)
    leaves = np.bincount(to_core[folded[0]], minlength=n).astype(float)
    inner = ~leaf[a] & ~leaf[b]
    a, b = to_core[a[inner]], to_core[b[inner]]
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    other = other[np.argsort(one, kind="stable")]
    size = np.bincount(one, minlength=n)
    begin = np.cumsum(size) - size
    near, near_leaf, through = np.zeros(n), np.zeros(n), np.zeros(n)
    sources = np.arange(part, n, parts)
    batch = max(1, CELLS // n)
    for i in range(0, len(sources), batch):
        s = sources[i : i + batch]
        k, row = len(s), np.arange(len(s))
        cells = k * n
        start = row * n + s
        seen, paths = np.zeros(cells, bool), np.zeros(cells)
        seen[start], paths[start] = True, 1.0
        r, r_leaf = leaves[s].copy(), 1 + (leaves[s] - 1) / 2  # a leaf counts itself in neither
        reached = 1 + leaves[s]
        owed, steps, front, d = np.zeros(cells), [], start, 0
        while True:
            v = front % n
            c = size[v]
            at = np.arange(c.sum()) + np.repeat(begin[v] - (np.cumsum(c) - c), c)
            to = other[at] + np.repeat(front - v, c)
            new = ~seen[to]
            to, by = to[new], np.repeat(front, c)[new]
            if not len(to):
                break
            d += 1
            front, sums = _added(to, paths[by], cells)
            seen[front], paths[front] = True, sums
            steps.append((by, to))
            which, there = front // n, leaves[front % n]
            m, l = np.bincount(which, minlength=k), np.bincount(which, weights=there, minlength=k)
            r += m / d + l / (d + 1)
            r_leaf += m / (d + 1) + l / (d + 2)
            reached += m + l
            owed[front] = there  # paths to the leaves of a vertex lead through it
        for by, to in reversed(steps):
            places, sums = _added(by, paths[by] / paths[to] * (1 + owed[to]), cells)
            owed[places] += sums
        owed *= np.repeat(1 + leaves[s], n)
        owed[start] = leaves[s] * (reached - 2)  # from its own leaves to all others but itself
        through += owed.reshape(k, n).sum(axis=0)
        near[s], near_leaf[s] = r, r_leaf
    mine = np.zeros(n, bool)
    mine[sources] = True
    of_leaves = mine[to_core[folded[0]]]
    at, own = folded[1][of_leaves], to_core[folded[0][of_leaves]]
    hit = np.flatnonzero(through)
    return np.concatenate([names[core[sources]], names[at]]), np.concatenate([near[sources], near_leaf[own]]), names[core[hit]], through[hit]


def centralities(g: Graph) -> DataFrame:
    """(graph_id, entity_name, closeness, betweenness) without directions: the mean of one over the distance to all others, 0 for
    those out of reach, and the shares of shortest paths between pairs of others that lead through it.

    A task has the pairs of a whole graph, as numbers, and a part of its vertices as sources: the work grows with vertices times
    pairs, but only pairs are moved, at most ``MOST_PARTS`` times, and a row per vertex and part comes back.
    """
    e = pairs(g).where(F.col("source") != F.col("target"))
    u = cut(e.select(G, F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).distinct())
    v = cut(u.select(G, F.col("x").alias("v")).union(u.select(G, "y")).distinct().withColumn("id", F.monotonically_increasing_id()))
    size = v.count()
    x, y = v.toDF(G, "x", "a"), v.toDF(G, "y", "b")
    numbered = cut(spread_join(spread_join(u, x, [G, "x"], size), y, [G, "y"], size).select(G, "a", "b"))
    work = v.groupBy(G).agg(F.min("id").alias("g"), F.count("*").alias("n_v")).join(numbered.groupBy(G).agg(F.count("*").alias("n_e")), G)
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("n_v") * F.col("n_e") / PART_WORK)).cast("int")
    given = numbered.join(hint_small(cut(work.select(G, "g", parts.alias("parts"))), SMALL_GRAPHS), G)
    given = given.select("g", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a", "b")

    def one(t: pa.Table) -> pa.Table:
        at, r, mid, b = reach(t["a"].to_numpy(), t["b"].to_numpy(), t["part"][0].as_py(), t["parts"][0].as_py())
        nothing = np.zeros(len(at)), np.zeros(len(mid))
        return pa.table({"id": np.concatenate([at, mid]), "r": np.concatenate([r, nothing[1]]), "b": np.concatenate([nothing[0], b])})

    found = given.groupBy("g", "part").applyInArrow(one, "id long, r double, b double").groupBy("id").agg(F.sum("r").alias("r"), (F.sum("b") / 2).alias("b"))
    named = v.join(found, "id").select(G, F.col("v").alias("entity_name"), "r", "b")
    n = g.vertices.groupBy(G).agg(F.count("*").alias("n"))
    out = g.vertices.select(G, "entity_name").join(hint_small(n, SMALL_GRAPHS), G).join(named, [G, "entity_name"], "left")
    return out.select(G, "entity_name", F.coalesce(F.try_divide("r", F.col("n") - 1), F.lit(0.0)).alias("closeness"), F.coalesce("b", F.lit(0.0)).alias("betweenness"))
