"""Network statistics on graphs small enough to do by hand, and against brute force."""

import itertools
import random

import pytest

from tidegraph import session
from tidegraph.operators import network as N

NODES = "graph_id string, entity_name string, entity_type string, num_appearances long"
EDGES = "graph_id string, source string, target string, head_verb_lemma string, head_verb_tense string"


def make(spark, nodes, edges, **options):
    return N.graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), **options)


@pytest.fixture(scope="module")
def graphs(spark):
    nodes = [("t", x, "ORG", 1) for x in "abc"] + [("t", "z", "GPE", 1)] + [("m", "p", "ORG", 2), ("m", "q", "GPE", 1)] + [("i", "x", None, 1)]
    edges = [("t", "a", "b", "run", "VBZ"), ("t", "b", "c", "run", "VBD"), ("t", "a", "c", "see", "VBZ")]
    edges += [("m", "p", "q", "run", "VB"), ("m", "q", "p", "run", "VB"), ("m", "p", "p", "go", "VBG"), ("m", "p", None, "go", "VBG"), ("m", "p", "unknown", "go", "VB")]
    return nodes, edges


def one(df, g):
    return next(r for r in df.collect() if r.graph_id == g)


def test_by_hand(spark, graphs):
    g = make(spark, *graphs)
    assert one(N.sizes(g), "t")[1:] == (4, 3) and one(N.sizes(g), "m")[1:] == (2, 3) and one(N.sizes(g), "i")[1:] == (1, 0)
    assert one(N.connectedness(g), "t").connectedness == pytest.approx(6 / 12)
    assert one(N.connectedness(g), "i").connectedness is None
    assert one(N.transitivity(g), "t").transitivity == 1.0
    assert one(N.reciprocity(g), "m").reciprocity == 1.0 and one(N.reciprocity(g), "t").reciprocity == 0.0
    assert one(N.homophily(g), "m").pct_entitytype_homophily == pytest.approx(1 / 3)
    assert one(N.degree_stats(g), "t")[1:] == (0.75, 0.75, 0.5, 0.5)
    assert one(N.density(g), "m").density == pytest.approx(3 / 4)
    assert one(N.tense_shares(g), "t").percent_vbz == pytest.approx(2 / 3)


def test_loops_isolates_collapse(spark, graphs):
    assert make(spark, *graphs, self_loops=False).edges.where("graph_id = 'm'").count() == 2
    assert {r.entity_name for r in make(spark, *graphs, keep_isolates=False).vertices.collect()} == {"a", "b", "c", "p", "q"}
    c = make(spark, graphs[0], graphs[1] + [("t", "a", "b", "x", "VB")], collapse_edges=True)
    assert {(r.source, r.target): r.weight for r in c.edges.where("graph_id = 't'").collect()}["a", "b"] == 2
    for bad in ({"export_format": "x"}, {"self_loops": None}):
        with pytest.raises(ValueError):
            make(spark, *graphs, **bad)


def test_all_statistics_have_their_columns(spark, graphs):
    multi = N.statistics(make(spark, *graphs))
    assert len(multi.columns) == 1 + 11 + 8 and multi.count() == 3
    weighted = N.statistics(make(spark, *graphs, collapse_edges=True))
    assert len(weighted.columns) == 1 + 11 + 8 and weighted.count() == 3
    assert N.statistics(make(spark, [], [])).count() == 0


def test_transitivity_and_components_against_brute_force(spark):
    rng = random.Random(1)
    names = [f"v{i}" for i in range(14)]
    edges = [("r", rng.choice(names), rng.choice(names), "x", "VB") for _ in range(45)] + [("h", "hub", f"s{i}", "x", "VB") for i in range(60)] + [("h", f"s{i}", f"s{i + 1}", "x", "VB") for i in range(0, 58, 2)]
    nodes = sorted({(g, n, "T", 1) for g, s, t, *_ in edges for n in (s, t)})
    g = make(spark, nodes, edges)
    for key in ("r", "h"):
        p = {(s, t) for k, s, t, *_ in edges if k == key and s != t}
        vs = {x for e in p for x in e}
        two = [(i, k) for i, j, k in itertools.permutations(vs, 3) if (i, j) in p and (j, k) in p]
        assert one(N.transitivity(g), key).transitivity == pytest.approx(sum(e in p for e in two) / len(two) if two else 0)
    chain = [("c", f"n{i:03}", f"n{i + 1:03}", "x", "VB") for i in range(120)]
    long = make(spark, sorted({("c", n, "T", 1) for _, s, t, *_ in chain for n in (s, t)}), chain)
    assert {r.component for r in N.components(long).collect()} == {"n000"}


def test_louvain_finds_two_cliques(spark):
    def clique(p):
        return [("g", f"{p}{i}", f"{p}{j}", "x", "VB") for i in range(5) for j in range(i)]

    edges = [*clique("a"), *clique("b"), ("g", "a0", "b0", "x", "VB")]
    nodes = [("g", f"{p}{i}", "T", 1) for p in "ab" for i in range(5)]
    for most in (N.TASK_PAIRS, 0):  # in tasks, and by joins
        found = N.communities(make(spark, nodes, edges), most)
        sets = {}
        for r in found.collect():
            sets.setdefault(r.community, set()).add(r.entity_name[0])
        assert sorted(map(sorted, sets.values())) == [["a"], ["b"]]
        q = N.modularity(make(spark, nodes, edges), found).first()
        assert q.modularity == pytest.approx(20 / 21 - 2 * (21 / 42) ** 2) and q.num_communities == 2


def test_composites_and_rankings(spark, graphs):
    nodes, edges = graphs
    nodes = nodes + [("m", "a", "PERSON", 9)]
    g = make(spark, nodes, edges)
    n, e = N.combine(g.vertices, g.edges, "multiplex")
    a = n.where("entity_name = 'a'").first()
    assert (a.entity_type, a.num_appearances, a.num_graphs_in) == ("PERSON", 9, 2) and e.count() == 6
    assert N.combine(g.vertices, g.edges, "weighted")[1].where("source = 'p' and target = 'p'").first().weight == 1
    with pytest.raises(ValueError):
        N.combine(g.vertices, g.edges, "both")
    shares = {r.entity_name: r.avg_share for r in N.top_entities(g).collect()}
    assert shares["a"] == pytest.approx(2 / 6 / 3) and shares["p"] == pytest.approx(4 / 6 / 3)
    assert {r.head_verb_lemma: r.avg_share for r in N.top_lemmas(g).collect()}["run"] == pytest.approx((2 / 3 + 2 / 3) / 3)
    metrics = {(r.graph_id, r.entity_name): r for r in N.node_metrics(g).collect()}
    assert metrics["m", "p"].mutual_share == 1.0 and metrics["t", "z"].n_partners == 0


def test_communities_are_the_same_in_tasks_and_by_joins(spark):
    rng = random.Random(11)
    edges = [("star", "z", f"s{i}", "go", "VB") for i in range(6)] + [("pair", "b", "a", "go", "VB")] + [("ring", f"r{i}", f"r{(i + 1) % 9}", "go", "VB") for i in range(9)]
    edges += [("blocks", f"{b}{rng.randrange(5)}", f"{b}{rng.randrange(5)}", "go", "VB") for b in "xyz" for _ in range(25)] + [("blocks", "x0", "y0", "go", "VB"), ("blocks", "y1", "z1", "go", "VB")]
    nodes = sorted({(g, v, "ORG", 1) for g, a, b, *_ in edges for v in (a, b)}) + [("alone", "q", "ORG", 1)]
    g = make(spark, nodes, edges, collapse_edges=True)
    here, there = ({(r.graph_id, r.entity_name): r.community for r in N.communities(g, n).collect()} for n in (N.TASK_PAIRS, 0))
    assert here == there and len(here) == len(nodes)
    assert {v for (k, _), v in here.items() if k == "star"} == {"s0"} and here["pair", "b"] == "a" and here["alone", "q"] == "q"
    assert all(v[0] == name[0] for (k, name), v in here.items() if k == "blocks")


def shortest(links, names):
    """(distance, number of shortest paths) by ordered pair."""
    out = {}
    for s in names:
        dist, count, queue = {s: 0}, {s: 1}, [s]
        for v in queue:
            for w in sorted(links[v]):
                if w not in dist:
                    dist[w], count[w] = dist[v] + 1, 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        out |= {(s, v): (dist[v], count[v]) for v in dist}
    return out


def test_node_metrics_against_brute_force(spark):
    rng = random.Random(4)
    names = [f"v{i}" for i in range(9)]
    edges = sorted({("g", *rng.sample(names[:8], 2), "go", "VB") for _ in range(17)}) + [("g", "v0", "v0", "go", "VB")]
    g = make(spark, [("g", v, "ORG", 1) for v in names], edges)
    links = {v: {b if a == v else a for _, a, b, *_ in edges if v in (a, b)} - {v} for v in names}
    near = shortest(links, names)
    got = {r.entity_name: r for r in N.centralities(g).collect()}
    for v in names:
        close = sum(1 / d for (s, t), (d, _) in near.items() if s == v and d) / 8
        between = sum(
            near[s, v][1] * near[v, t][1] / near[s, t][1]
            for s, t in itertools.combinations(names, 2)
            if v not in (s, t) and (s, t) in near and (s, v) in near and (v, t) in near and near[s, v][0] + near[v, t][0] == near[s, t][0]
        )
        assert got[v].closeness == pytest.approx(close) and got[v].betweenness == pytest.approx(between)
    a = {(x, y): 0 for x in names for y in names} | {(x, y): 1 for _, x, y, *_ in edges if x != y}
    both = {k: a[k] + a[k[::-1]] for k in a}
    got = {r.entity_name: r.clustering for r in N.clustering(g).collect()}
    for v in names:
        d, r = sum(both[v, w] for w in names), sum(a[v, w] * a[w, v] for w in names)
        n = sum(both[v, x] * both[x, y] * both[y, v] for x in names for y in names) / 2
        assert got[v] == pytest.approx(n / (d * (d - 1) - 2 * r) if d * (d - 1) - 2 * r else 0)
    assert N.centralities(make(spark, [("g", "a", None, 1)], [])).collect()[0][2:] == (0.0, 0.0)


def test_centralities_by_parts_keep_no_pairs_of_vertices(spark, monkeypatch):
    """Graphs whose sources are parted: leaves, a pair alone, a star, several components; what is written grows with the pairs, not with pairs of vertices."""
    rng = random.Random(5)
    ties = {"pair": [("a", "b")], "star": [("hub", f"s{i}") for i in range(5)], "two": [("p", "q"), ("q", "r"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w")]}
    ties["large"] = sorted({tuple(sorted(rng.sample([f"v{i}" for i in range(300)], 2))) for _ in range(420)})
    edges = [(g, a, b, "go", "VB") for g, xs in ties.items() for a, b in xs]
    nodes = sorted({(g, v, "ORG", 1) for g, a, b, *_ in edges for v in (a, b)})
    monkeypatch.setattr(N, "PART_WORK", 10_000, raising=False)
    monkeypatch.setattr(N, "MOST_PARTS", 5, raising=False)
    written = []
    kept = {name: getattr(N, name) for name in ("cut", "cut_in_loop")}
    for name, f in kept.items():
        monkeypatch.setattr(N, name, lambda df, f=f: written.append((out := f(df)).count()) or out)
    got = {(r.graph_id, r.entity_name): (r.closeness, r.betweenness) for r in N.centralities(make(spark, nodes, edges)).collect()}
    assert len(got) == len(nodes) and max(written) <= len(edges)
    for g, xs in ties.items():
        names = sorted({v for x in xs for v in x})
        links = {v: {b if a == v else a for a, b in xs if v in (a, b)} for v in names}
        near = shortest(links, names)
        between = dict.fromkeys(names, 0.0)
        for s, t in near:
            if s < t:
                for v in names:
                    if v not in (s, t) and (s, v) in near and near[s, v][0] + near[v, t][0] == near[s, t][0]:
                        between[v] += near[s, v][1] * near[v, t][1] / near[s, t][1]
        for v in names:
            close = sum(1 / d for (s, _), (d, _) in near.items() if s == v and d) / (len(names) - 1)
            assert got[g, v] == pytest.approx((close, between[v]))


def test_graph_files_and_rankings(spark, graphs, tmp_path):
    g = make(spark, *graphs, collapse_edges=True, self_loops=False)
    N.write_graph(g, str(tmp_path / "g"))
    back = N.read_graph(spark, str(tmp_path / "g"))
    assert (back.self_loops, back.collapsed) == (False, True) and sorted(back.edges.collect()) == sorted(g.edges.collect())
    N.write_graph(make(spark, *graphs), str(tmp_path / "m"))
    here, there = N.top_features(make(spark, *graphs)), N.top_features(str(tmp_path / "m"), spark)
    assert [x.collect() for x in here] == [x.collect() for x in there]
    shares = [(-r.avg_share, r.entity_name) for r in there[0].collect()]
    assert shares == sorted(shares) and len(shares) == 7
    with pytest.raises(Exception, match="exists"):
        N.write_graph(g, str(tmp_path / "g"), overwrite=False)


def test_components_of_a_star_beyond_the_small_side(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL_SIDE", 0)
    monkeypatch.setattr(session, "HEAVY_KEY", 9)
    edges = [("g", "hub", f"s{i}", "go", "VB") for i in range(40)] + [("g", f"c{i}", f"c{i + 1}", "go", "VB") for i in range(12)]
    nodes = sorted({("g", v, "ORG", 1) for _, a, b, *_ in edges for v in (a, b)})
    got = {r.entity_name: r.component for r in N.components(make(spark, nodes, edges)).collect()}
    assert got == {v: "hub" if v[0] in "hs" else "c0" for _, v, *_ in nodes}
