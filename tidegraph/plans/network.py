"""Queries of the network operators over the extracts of all files; each file is a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import network as N
from tidegraph.session import scratch, table


def base_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, entity_name, entity_type, num_appearances): a file's extracts together, each node
    counted once; the type is that with most appearances, of equals the first in the alphabet."""
    n = table(spark, sf_dir, "nodelist").where(F.col("entity_name") != "").select("node_id", "file_id", "entity_name", "entity_type", "num_appearances").distinct()
    by_type = n.groupBy("file_id", "entity_name", "entity_type").agg(F.sum(F.coalesce("num_appearances", F.lit(0))).alias("n"))
    return by_type.groupBy(F.col("file_id").alias("graph_id"), "entity_name").agg(
        F.min_by("entity_type", F.struct(F.col("entity_type").isNull(), -F.col("n"), "entity_type")).alias("entity_type"), F.sum("n").alias("num_appearances")
    )


def base_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered edge once."""
    e = table(spark, sf_dir, "edgelist").where((F.col("source") != "") & (F.col("target") != ""))
    return e.select("edge_id", F.col("file_id").alias("graph_id"), "source", "target", "head_verb_lemma", "head_verb_tense").distinct()


def a_graph(spark: SparkSession, sf_dir: str, **options) -> N.Graph:
    return N.graph(base_nodes(spark, sf_dir), base_edges(spark, sf_dir), **options)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _stat(f, **options):
    return lambda spark, sf_dir: _rounded(f(a_graph(spark, sf_dir, **options)))


def q_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = a_graph(spark, sf_dir, keep_isolates=False, collapse_edges=True)
    return _rounded(N.modularity(g, N.communities(g)))


def q_combine(mode: str, part: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = a_graph(spark, sf_dir, keep_isolates=False)
        nodes, edges = N.combine(g.vertices, g.edges, mode)
        return (nodes, edges)[part]

    return run


def q_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collapsed graphs, written to files and read again."""
    path = scratch(spark, "graphs")
    N.write_graph(a_graph(spark, sf_dir, collapse_edges=True), path)
    return N.read_graph(spark, path).edges


QUERIES = {
    "graph_roundtrip": q_roundtrip,
    "node_clustering": _stat(N.clustering),
    "node_centrality": _stat(N.centralities),
    "top_features_entities": lambda s, d: _rounded(N.top_features(a_graph(s, d))[0].limit(20)),
    "top_features_lemmas": lambda s, d: _rounded(N.top_features(a_graph(s, d))[1].limit(20)),
    "net_vertices": lambda s, d: a_graph(s, d).vertices,
    "net_collapse": lambda s, d: a_graph(s, d, collapse_edges=True).edges,
    "net_no_loops": lambda s, d: a_graph(s, d, self_loops=False).edges.select("graph_id", "edge_id", "source", "target"),
    "net_no_isolates": lambda s, d: a_graph(s, d, keep_isolates=False).vertices,
    "net_sizes": _stat(N.sizes),
    "net_degree_stats": _stat(N.degree_stats),
    "net_strength_stats": _stat(lambda g: N.degree_stats(g, "strength", True), collapse_edges=True),
    "net_density": _stat(N.density, collapse_edges=True),
    "net_reciprocity": _stat(N.reciprocity),
    "net_homophily": _stat(N.homophily),
    "net_centralization": _stat(N.centralization),
    "net_transitivity": _stat(N.transitivity),
    "net_tense_pct": _stat(N.tense_shares),
    "net_connectedness": _stat(N.connectedness),
    "net_components": lambda s, d: N.components(a_graph(s, d)),
    "net_communities": q_communities,
    "net_stats_multiplex": _stat(N.statistics, keep_isolates=False),
    "net_stats_weighted": _stat(N.statistics, keep_isolates=False, collapse_edges=True, self_loops=False),
    "net_stats_common": _stat(lambda g: N.statistics(g).drop("modularity", "num_communities")),
    "node_metrics": _stat(N.node_metrics),
    "node_overlap": lambda s, d: N.overlap(a_graph(s, d).vertices),
    "combine_nodes": q_combine("multiplex", 0),
    "combine_multiplex": lambda s, d: q_combine("multiplex", 1)(s, d).groupBy("head_verb_lemma").agg(F.count("*").alias("n_edges")),
    "combine_weighted": q_combine("weighted", 1),
    "top_entities": _stat(N.top_entities),
    "top_lemmas": _stat(N.top_lemmas),
}

_BASE = """
with recursive nd as (
  select distinct node_id, file_id, entity_name, entity_type, num_appearances from nodelist where entity_name <> ''),
bt as (select file_id, entity_name, entity_type, sum(coalesce(num_appearances, 0)) as n from nd group by all),
v as (
  select file_id as graph_id, entity_name, (array_agg(entity_type order by entity_type is null, n desc, entity_type))[1] as entity_type, sum(n)::bigint as num_appearances
  from bt group by file_id, entity_name),
e as (
  select distinct edge_id, file_id as graph_id, source, target, head_verb_lemma, head_verb_tense from edgelist e0
  where source <> '' and target <> ''
    and exists (select 1 from v where v.graph_id = e0.file_id and v.entity_name = e0.source)
    and exists (select 1 from v where v.graph_id = e0.file_id and v.entity_name = e0.target)),
p as (select graph_id, source, target, count(*) as weight from e group by all),
nv as (select graph_id, count(*) as n from v group by graph_id),
dg as (
  select v.graph_id, v.entity_name, coalesce(o.o, 0) as o, coalesce(i.i, 0) as i from v
  left join (select graph_id, source, count(*) as o from e group by all) o on o.graph_id = v.graph_id and o.source = v.entity_name
  left join (select graph_id, target, count(*) as i from e group by all) i on i.graph_id = v.graph_id and i.target = v.entity_name),
cv as (select * from v where exists (select 1 from e where e.graph_id = v.graph_id and (e.source = v.entity_name or e.target = v.entity_name)))
"""
_REACH = """, und as (select distinct graph_id, source as x, target as y from p where source <> target union select graph_id, target, source from p where source <> target),
reach as (
  select graph_id, entity_name as x, entity_name as y from v
  union
  select r.graph_id, r.x, u.y from reach r join und u on u.graph_id = r.graph_id and u.x = r.y)
"""

ORACLE = {
    "graph_roundtrip": _BASE + "select graph_id, source, target, weight from p",
    "node_clustering": _BASE
    + """, q as (select graph_id, source, target from p where source <> target),
s as (select graph_id, x, y, count(*) as s from (select graph_id, source as x, target as y from q union all select graph_id, target, source from q) group by all),
d as (select graph_id, x, sum(s) as d, count(*) filter (where s = 2) as r from s group by all),
t as (select a.graph_id, a.x, sum(a.s * b.s * c.s) / 2 as n from s a join s b on b.graph_id = a.graph_id and b.x = a.y join s c on c.graph_id = a.graph_id and c.x = b.y and c.y = a.x group by all)
select v.graph_id, v.entity_name, round(case when d * (d - 1) - 2 * r > 0 then coalesce(n, 0) / (d * (d - 1) - 2 * r) else 0.0 end, 9) as clustering
from v left join d on d.graph_id = v.graph_id and d.x = v.entity_name left join t on t.graph_id = v.graph_id and t.x = v.entity_name""",
    "net_vertices": _BASE + "select * from v",
    "net_collapse": _BASE + "select graph_id, source, target, weight from p",
    "net_no_loops": _BASE + "select graph_id, edge_id, source, target from e where source <> target",
    "net_no_isolates": _BASE + "select * from cv",
    "net_sizes": _BASE + "select nv.graph_id, n as num_nodes, coalesce(m, 0) as num_edges from nv left join (select graph_id, count(*) as m from e group by 1) using (graph_id)",
    "net_degree_stats": _BASE
    + """select graph_id, round(avg(i), 9) as mean_in_degree, round(avg(o), 9) as mean_out_degree,
  median(i)::double as median_in_degree, median(o)::double as median_out_degree from dg group by graph_id""",
    "net_strength_stats": _BASE
    + """select graph_id, round(avg(i), 9) as mean_in_strength, round(avg(o), 9) as mean_out_strength,
  median(i)::double as median_in_strength, median(o)::double as median_out_strength from dg group by graph_id""",
    "net_density": _BASE
    + "select nv.graph_id, round(coalesce(m, 0) / (n * n), 9) as density from nv left join (select graph_id, count(*) as m from p group by 1) using (graph_id)",
    "net_reciprocity": _BASE
    + """select a.graph_id, round(avg(case when b.source is null then 0 else 1 end), 9) as reciprocity
from p a left join p b on b.graph_id = a.graph_id and b.source = a.target and b.target = a.source group by 1""",
    "net_homophily": _BASE
    + """select e.graph_id, round(avg((a.entity_type = b.entity_type)::int), 9) as pct_entitytype_homophily from e
join v a on a.graph_id = e.graph_id and a.entity_name = e.source join v b on b.graph_id = e.graph_id and b.entity_name = e.target
where a.entity_type is not null and b.entity_type is not null group by 1""",
    "net_centralization": _BASE
    + """, d as (select v.graph_id, v.entity_name, (select count(*) from p where p.graph_id = v.graph_id and p.source = v.entity_name)
    + (select count(*) from p where p.graph_id = v.graph_id and p.target = v.entity_name) as d from v)
select graph_id, case when count(*) > 1 then round((max(d) * count(*) - sum(d)) / ((count(*) - 1) * (2 * (count(*) - 1) - 1)), 9) end as centralization from d group by 1""",
    "net_transitivity": _BASE
    + """, q as (select * from p where source <> target),
w as (select a.graph_id, a.source as i, b.target as k from q a join q b on b.graph_id = a.graph_id and b.source = a.target and b.target <> a.source)
select q0.graph_id, case when count(w.i) > 0 then round(count(q.source) / count(w.i), 9) end as transitivity
from (select distinct graph_id from q) q0 left join w using (graph_id)
left join q on q.graph_id = w.graph_id and q.source = w.i and q.target = w.k group by 1""",
    "net_tense_pct": _BASE
    + "select graph_id, "
    + ", ".join(f"round(avg((head_verb_tense = '{t}')::int), 9) as percent_{t.lower()}" for t in ("VBN", "VBG", "VBP", "VBD", "VB", "VBZ"))
    + " from e group by 1",
    "net_connectedness": _BASE
    + _REACH
    + """select nv.graph_id, case when n > 1 then round((select count(*) from reach r where r.graph_id = nv.graph_id and r.x <> r.y) / (n * (n - 1)), 9) end as connectedness from nv""",
    "net_components": _BASE + _REACH + "select graph_id, x as entity_name, min(y) as component from reach group by 1, 2",
    "node_metrics": _BASE
    + """, q as (select graph_id, source, target from p where source <> target),
pt as (select graph_id, source as x, target as y from q union select graph_id, target, source from q),
mt as (select pt.graph_id, pt.x, count(*) as n_partners, avg((exists (select 1 from q where q.graph_id = pt.graph_id and q.source = pt.x and q.target = pt.y)
  and exists (select 1 from q where q.graph_id = pt.graph_id and q.source = pt.y and q.target = pt.x))::int) as m from pt group by all)
select dg.graph_id, dg.entity_name, i as in_degree, o as out_degree, coalesce(n_partners, 0) as n_partners, round(m, 9) as mutual_share
from dg left join mt on mt.graph_id = dg.graph_id and mt.x = dg.entity_name""",
    "node_overlap": _BASE + "select n_graphs, count(*) as n_names from (select entity_name, count(distinct graph_id) as n_graphs from v group by 1) group by 1",
    "combine_nodes": _BASE
    + """select entity_name, entity_type, num_appearances, n as num_graphs_in from (
  select *, row_number() over (partition by entity_name order by num_appearances desc, graph_id, coalesce(entity_type, '')) as r, count(*) over (partition by entity_name) as n from cv)
where r = 1""",
    "combine_multiplex": _BASE + "select head_verb_lemma, count(*) as n_edges from e group by 1",
    "combine_weighted": _BASE + "select source, target, count(*) as weight from e group by all",
    "top_entities": _BASE
    + """select entity_name, round(sum(d / t) / (select count(distinct graph_id) from v), 9) as avg_share
from (select graph_id, entity_name, (i + o) as d, sum(i + o) over (partition by graph_id) as t from dg) where regexp_matches(entity_name, '[A-Za-z]') group by 1""",
    "top_lemmas": _BASE
    + """select head_verb_lemma, round(sum(c / t) / (select count(distinct graph_id) from v), 9) as avg_share
from (select graph_id, head_verb_lemma, count(*) as c, sum(count(*)) over (partition by graph_id) as t from e where head_verb_lemma is not null group by 1, 2) group by 1""",
}
ORACLE["top_features_entities"] = ORACLE["top_entities"] + " order by avg_share desc, entity_name limit 20"
ORACLE["top_features_lemmas"] = ORACLE["top_lemmas"] + " order by avg_share desc, head_verb_lemma limit 20"
#: All statistics but those of communities, which SQL can't find.
ORACLE["net_stats_common"] = "select * from " + " left join ".join(
    f"({ORACLE[n]})" + (f" x{i} using (graph_id)" if i else " x0")
    for i, n in enumerate(("net_sizes", "net_connectedness", "net_centralization", "net_transitivity", "net_homophily", "net_reciprocity", "net_degree_stats", "net_tense_pct"))
)
