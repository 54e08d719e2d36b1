"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import schemas as S
from tidegraph.operators.crawl import sentences
from tidegraph.plans.extraction import CRAWL_SQL
from tidegraph.session import scratch, table
from tidegraph.streaming.events import crawl_stream, read_stream, run_once, windowed_counts


def q_stream_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered edge rows per verb and 30 days of delivery, from a stream of the edge table."""
    rows = read_stream(spark, f"{sf_dir}/edgelist.parquet").select("loaded_at", "head_verb_lemma")
    counts = run_once(windowed_counts(rows, "loaded_at", "head_verb_lemma"), "edge-counts")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "head_verb_lemma", "n")


def q_stream_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The climb over a stream of whole sentences."""
    path = scratch(spark, "sentences")
    sentences(table(spark, sf_dir, "tokens")).write.parquet(path)
    return run_once(crawl_stream(read_stream(spark, path)), "crawl", "append").select(*S.SENTENCE, "token_id", "role", "verb_id")


QUERIES = {"stream_edge_counts": q_stream_edge_counts, "stream_crawl": q_stream_crawl}

ORACLE = {
    "stream_edge_counts": """
select strftime(make_timestamp((epoch_us(loaded_at) // 2592000000000) * 2592000000000), '%Y-%m-%d') as window_start, head_verb_lemma, count(*) as n
from edgelist where loaded_at is not null group by all""",
    "stream_crawl": CRAWL_SQL + "select file_id, doc_id, sentence_id, id as token_id, role, verb_id from c",
}
