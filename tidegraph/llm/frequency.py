"""Frequencies of every distinct term of a collection, by recursive radix partitions and DuckDB.

Occurrences are first combined per (field, term, file), then per (field, term, bucket of files): a file is in one
bucket, so files and occurrences add up, and a term that fills a third of all rows is at most ``FILE_BUCKETS``
rows from there on. Those are partitioned by the leading bits of the term's hash; partitions above the row
limit are split by further bits, again and again, until each fits or holds a single term. Spark's exchange
writes the partitions to disk, and each streams, as Arrow batches, into a DuckDB aggregate that works out of core
under a memory limit. Oversized prefixes stay in a table; nothing of them comes to the driver.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.session import cut, hint_small, shared_dir, table

#: Rows of a partition, and the memory of its aggregate.
PARTITION_ROWS, MEMORY = 250_000, "256MB"
STEP_BITS, FILE_BUCKETS, SMALL_PREFIXES = 6, 64, 100_000
#: The setting that names where DuckDB spills; see ``spill_dir``.
SPILL_SETTING = "spark.tidegraph.spill.dir"
RARE, COMMON_SHARE_INVERSE = 3, 4


def radix(df: DataFrame, code: str, limit: int, step: int = STEP_BITS, rows: int | None = None) -> DataFrame:
    """``df`` with ``part``: the partition as text "bits:prefix", from the leading bits of the long column ``code``.

    The first level has enough bits for partitions of a quarter of ``limit`` rows if hashes are even; those
    that are above the limit nevertheless get ``step`` more bits at a time, unless they hold one code only.
    """
    n = df.count() if rows is None else rows
    at = min(64, max(0, math.ceil(math.log2(max(1, n) / limit)) + 2)) if n > limit else 0

    def prefix(bits: int) -> Column:
        return F.shiftrightunsigned(code, 64 - bits) if bits else F.lit(0).cast("long")

    def name(bits: int) -> Column:
        return F.concat(F.lit(f"{bits}:"), prefix(bits).cast("string"))

    out, part = df.withColumn("part", name(at)), df.select(code)
    while at < 64:
        over = cut(
            part.groupBy(prefix(at).alias("__p")).agg(F.count("*").alias("n"), F.min(code).alias("a"), F.max(code).alias("b"))
            .where((F.col("n") > limit) & (F.col("a") != F.col("b"))).select("__p", F.lit(True).alias("__over"))
        )
        count = over.count()
        if not count:
            break
        over = hint_small(over, SMALL_PREFIXES, count)
        part = part.withColumn("__p", prefix(at)).join(over, "__p", "left_semi").select(code)
        deeper = min(64, at + step)
        # Only rows that the levels before have split can be split here.
        out = out.withColumn("__p", F.when(F.col("part") == name(at), prefix(at))).join(over, "__p", "left").withColumn("part", F.when(F.col("__over"), name(deeper)).otherwise(F.col("part"))).drop("__p", "__over")
        at = deeper
    return out


def spill_dir(spark: SparkSession) -> str:
    """Where a task's DuckDB spills: what ``spark.tidegraph.spill.dir`` names; else the shared folder if it is a plain path; else,
    as DuckDB can't write there, "", which stands for the executor's own folders for spilling (SPARK_LOCAL_DIRS). What
    is spilled belongs to one running task and is gone with it, like Spark's own spills."""
    if given := spark.conf.get(SPILL_SETTING, None):
        return given
    shared = shared_dir(spark)
    return shared[7:] if shared.startswith("file://") else ""


def _spill_here(folder: str) -> str:
    local = folder or os.environ.get("SPARK_LOCAL_DIRS", os.environ.get("LOCAL_DIRS", "")).split(",")[0] or tempfile.gettempdir()
    return os.path.join(local, "duckdb-spill", uuid.uuid4().hex)


def term_counts(rows: DataFrame, limit: int = PARTITION_ROWS, memory: str = MEMORY) -> DataFrame:
    """(field_name, term, n_occurrences, n_files) of rows (field_name, term, file_id, n).

    Null and empty terms are left out; a null n counts 0; a null file_id is no file but its
    occurrences count. Extra columns play no part. An empty table gives no rows.
    """
    spark = rows.sparkSession
    combined = rows.where(F.col("term") != "").groupBy("field_name", "term", "file_id").agg(F.sum(F.coalesce(F.col("n").cast("long"), F.lit(0))).alias("n"))
    bucket = F.pmod(F.hash("file_id"), F.lit(FILE_BUCKETS))
    stored = cut(
        combined.groupBy("field_name", "term", bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("file_id").alias("files"))
        .select("field_name", "term", "n", "files", F.xxhash64("field_name", "term").alias("h"))
    )
    count = stored.count()
    limit = max(1, min(limit, -(-count // spark.sparkContext.defaultParallelism)))
    placed = radix(stored, "h", limit, rows=count).select("part", "field_name", "term", "n", "files")
    folder = spill_dir(spark)

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        held = pa.RecordBatchReader.from_batches(first.schema, _chain(first, batches))
        own = _spill_here(folder)
        con = duckdb.connect(config={"memory_limit": memory, "threads": "1", "temp_directory": own, "preserve_insertion_order": "false"})
        try:
            con.register("held", held)
            done = con.execute("select field_name, term, sum(n)::bigint as n_occurrences, sum(files)::bigint as n_files from held group by field_name, term")
            yield from (b.cast(OUT) for b in _reader(done))
        finally:
            con.close()
            _remove(own)

    return placed.groupBy("part").applyInArrow(aggregate, "field_name string, term string, n_occurrences long, n_files long")


OUT = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("n_occurrences", pa.int64()), ("n_files", pa.int64())])


def _reader(result) -> pa.RecordBatchReader:
    return result.to_arrow_reader(65536) if hasattr(result, "to_arrow_reader") else result.fetch_record_batch(65536)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def term(c: Column) -> Column:
    """Leading and trailing blanks off, in lower case."""
    return F.lower(F.trim(c))


def occurrences(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per edge and per node that was delivered, however often."""
    e = edges.select("edge_id", "file_id", term(F.col("head_verb_lemma")).alias("term")).distinct()
    n = nodes.select("node_id", "file_id", term(F.col("entity_name")).alias("term"), F.col("num_appearances").alias("n")).distinct()
    return e.select(F.lit("head_verb_lemma").alias("field_name"), "term", "file_id", F.lit(1).cast("long").alias("n")).unionByName(
        n.select(F.lit("entity_name").alias("field_name"), "term", "file_id", "n")
    )


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = table(spark, sf_dir, "edgelist"), table(spark, sf_dir, "nodelist")
    counts = term_counts(occurrences(edges, nodes))
    files = {name: df.select("file_id").distinct().agg(F.count("file_id")).scalar() for name, df in (("head_verb_lemma", edges), ("entity_name", nodes))}
    total = F.when(F.col("field_name") == "entity_name", files["entity_name"]).otherwise(files["head_verb_lemma"])
    mark = F.when(F.col("n_files") * COMMON_SHARE_INVERSE > total, "common").when(F.col("n_occurrences") < RARE, "rare")
    return counts.select("*", mark.alias("mark"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms too rare or too common to be useful."""
    return marked(spark, sf_dir).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, files and mark of every term."""
    return marked(spark, sf_dir)


QUERIES = {"p4_found": p4_found, "p4_terms": p4_terms}

_TERMS_SQL = """
with o as (
  select 'head_verb_lemma' as field_name, lower(trim(head_verb_lemma, ' ')) as term, file_id, 1 as n
  from (select distinct edge_id, file_id, head_verb_lemma from edgelist)
  union all
  select 'entity_name', lower(trim(entity_name, ' ')), file_id, coalesce(num_appearances, 0)
  from (select distinct node_id, file_id, entity_name, num_appearances from nodelist)),
f as (
  select 'head_verb_lemma' as field_name, count(distinct file_id) as files from edgelist
  union all select 'entity_name', count(distinct file_id) from nodelist),
c as (
  select field_name, term, sum(n)::bigint as n_occurrences, count(distinct file_id) as n_files
  from o where term <> '' group by field_name, term),
m as (
  select c.*, case when n_files * 4 > files then 'common' when n_occurrences < 3 then 'rare' end as mark
  from c join f using (field_name))
"""
ORACLE = {
    "p4_found": _TERMS_SQL + "select field_name, term, mark from m where mark is not null",
    "p4_terms": _TERMS_SQL + "select field_name, term, n_occurrences, n_files, mark from m",
}
