"""Dependency trees of the parsed sentences (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.hierarchy import hierarchies
from tidegraph.session import table

SENTENCE = ["file_id", "doc_id", "sentence_id"]


def _trees(spark: SparkSession, sf_dir: str, with_lists: bool) -> DataFrame:
    root = (F.upper("dep_rel") == "ROOT") & ((F.col("head_token_id") == F.col("token_id")) | (F.col("head_token_id") == 0))
    return hierarchies(table(spark, sf_dir, "tokens"), SENTENCE, "token_id", "head_token_id", root, with_lists)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens whose heads lead to no root."""
    return _trees(spark, sf_dir, False).where(~F.col("kind").isin("root", "ok")).select(*SENTENCE, "token_id", "kind")


def p7_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token's path, depth, top and descendants (in ascending order), as text lists."""
    t = _trees(spark, sf_dir, True)
    return t.select(
        *SENTENCE,
        "token_id",
        "kind",
        "depth",
        "top",
        "n_below",
        F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"),
        F.concat_ws(" ", F.transform(F.array_sort("descendants"), lambda x: x.cast("string"))).alias("descendants"),
    )


QUERIES = {"p7_found": p7_found, "p7_trees": p7_trees}

_TREES_SQL = """
with recursive t as (
  select file_id, doc_id, sentence_id, token_id, min(head_token_id) as h,
    bool_or(upper(dep_rel) = 'ROOT' and (head_token_id = token_id or head_token_id = 0)) as r
  from tokens where token_id is not null group by all),
l as (
  select t.*, p.token_id as p from t left join t p
    on p.file_id is not distinct from t.file_id and p.doc_id is not distinct from t.doc_id
    and p.sentence_id is not distinct from t.sentence_id and p.token_id = t.h and not coalesce(t.r, false)),
k as (
  select *, case when r then 'root' when p = token_id then 'self' when p is null then 'orphan' end as own,
    case when p <> token_id then p end as up from l),
climb as (
  select file_id, doc_id, sentence_id, token_id as start, token_id as node, up, [token_id] as seen, false as closed from k
  union all
  select c.file_id, c.doc_id, c.sentence_id, c.start, k.token_id, k.up, list_prepend(k.token_id, c.seen), list_contains(c.seen, k.token_id)
  from climb c join k on k.file_id is not distinct from c.file_id and k.doc_id is not distinct from c.doc_id
    and k.sentence_id is not distinct from c.sentence_id and k.token_id = c.up
  where not c.closed),
oncycle as (
  select distinct file_id, doc_id, sentence_id, start as token_id from climb where closed and node = start),
anc as (
  select c.file_id, c.doc_id, c.sentence_id, c.start, c.node, c.seen, len(c.seen) - 1 as depth,
    (o.token_id is not null or c.up is null) as is_top
  from climb c left join oncycle o on o.file_id is not distinct from c.file_id and o.doc_id is not distinct from c.doc_id
    and o.sentence_id is not distinct from c.sentence_id and o.token_id = c.node
  where not c.closed),
tops as (
  select file_id, doc_id, sentence_id, start, node as top, seen, depth from anc where is_top
  qualify row_number() over (partition by file_id, doc_id, sentence_id, start order by depth) = 1),
below as (
  select a.file_id, a.doc_id, a.sentence_id, a.node as token_id, count(*) as n,
    string_agg(a.start::varchar, ' ' order by a.start) as d
  from anc a join tops p on p.file_id is not distinct from a.file_id and p.doc_id is not distinct from a.doc_id
    and p.sentence_id is not distinct from a.sentence_id and p.start = a.start
  where a.depth > 0 and a.depth <= p.depth group by all),
out as (
  select k.file_id, k.doc_id, k.sentence_id, k.token_id,
    case when k.own is not null then k.own when o.token_id is not null then 'cycle'
      when kt.own = 'root' then 'ok' else 'below' end as kind,
    p.depth, p.top, coalesce(b.n, 0) as n_below,
    array_to_string(p.seen, '/') as path, coalesce(b.d, '') as descendants
  from k
  join tops p on p.file_id is not distinct from k.file_id and p.doc_id is not distinct from k.doc_id
    and p.sentence_id is not distinct from k.sentence_id and p.start = k.token_id
  join k kt on kt.file_id is not distinct from k.file_id and kt.doc_id is not distinct from k.doc_id
    and kt.sentence_id is not distinct from k.sentence_id and kt.token_id = p.top
  left join oncycle o on o.file_id is not distinct from k.file_id and o.doc_id is not distinct from k.doc_id
    and o.sentence_id is not distinct from k.sentence_id and o.token_id = k.token_id
  left join below b on b.file_id is not distinct from k.file_id and b.doc_id is not distinct from k.doc_id
    and b.sentence_id is not distinct from k.sentence_id and b.token_id = k.token_id)
"""

ORACLE = {
    "p7_found": _TREES_SQL + "select file_id, doc_id, sentence_id, token_id, kind from out where kind not in ('root', 'ok')",
    "p7_trees": _TREES_SQL + "select * from out",
}
