"""Queries of the core's general operators on uneven keys (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.keys import hot_keys, key_profile
from tidegraph.session import table

SIDES = {"source": ("source", "target"), "target": ("target", "source")}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that at least 2 percent of the rows hold, all rows as stored."""
    edges = table(spark, sf_dir, "edgelist")
    profile = key_profile(edges, SIDES, "head_verb_lemma")
    return hot_keys(profile, edges.agg(F.count("*").alias("n")).scalar(), 50)


def p1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, distinct partners and distinct verbs of every name; a repeated edge counts once."""
    edges = table(spark, sf_dir, "edgelist").select("edge_id", "source", "target", "head_verb_lemma").distinct()
    profile = key_profile(edges, SIDES, "head_verb_lemma", "n_edges", "n_partners", "n_verbs")
    return profile.where(F.col("entity") != "")


QUERIES = {"p1_found": p1_found, "p1_names": p1_names}

_SIDES_SQL = """
    select 'source' as side, source as entity, nullif(target, '') as partner, head_verb_lemma as verb from e
    union all
    select 'target', target, nullif(source, ''), head_verb_lemma from e"""

ORACLE = {
    "p1_found": f"""
with e as (select source, target, head_verb_lemma from edgelist), s as ({_SIDES_SQL})
select side, entity from s where entity <> '' group by side, entity
having count(*) * 50 >= (select count(*) from e)""",
    "p1_names": f"""
with e as (select distinct edge_id, source, target, head_verb_lemma from edgelist), s as ({_SIDES_SQL})
select side, entity, count(*) as n_edges, count(distinct partner) as n_partners, count(distinct verb) as n_verbs
from s where entity <> '' group by side, entity""",
}
