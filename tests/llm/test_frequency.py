from collections import defaultdict

from pyspark.sql import functions as F

from tidegraph.llm import frequency
from tidegraph.llm.frequency import radix, term, term_counts

SCHEMA = "field_name string, term string, file_id string, n long, extra string"


def test_counts_with_nulls_ties_and_many_partitions(spark):
    rows = [("a", f"t{i % 97}", f"f{i % 13}", i % 3, "x") for i in range(3000)]
    rows += [("a", "hot", f"f{i}", 1, "x") for i in range(1500)] + [("b", "hot", None, None, "x"), ("b", None, "f", 1, "x"), ("b", "", "f", 1, "x"), ("b", "z", "f", 2, "x"), ("b", "z", "f", 2, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    n, files = defaultdict(int), defaultdict(set)
    for f, t, file, k, _ in rows:
        if t:
            n[f, t] += k or 0
            files[f, t] |= {file} if file else set()
    want = {(f, t, n[f, t], len(files[f, t])) for f, t in n}
    for limit in (250_000, 100, 7):
        got = [tuple(r) for r in term_counts(df, limit).collect()]
        assert set(got) == want and len(got) == len(want)
    assert term_counts(df.limit(0)).count() == 0


def test_radix_splits_until_it_fits(spark):
    df = spark.range(4000).select(F.xxhash64("id").alias("h")).union(spark.range(900).select(F.lit(7).cast("long").alias("h")))
    sizes = df.transform(lambda d: radix(d, "h", 100, 3)).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("h").alias("d")).collect()
    assert all(r.n <= 100 or r.d == 1 for r in sizes) and sum(r.n for r in sizes) == 4900
    assert any(r.n == 900 for r in sizes)


def test_terms(spark):
    df = spark.createDataFrame([(" Ab ",), ("\tx",), (None,)], "t string")
    assert [r[0] for r in df.select(term(F.col("t"))).collect()] == ["ab", "\tx", None]


def test_hot_prefixes_remote_folders_and_little_memory(spark, tmp_path, monkeypatch):
    """Codes that share their leading bits are split further; a hot term is few rows; DuckDB has a place to spill to."""
    near = spark.range(3000).select(F.expr("shiftleft(5L, 60) + id * 65536").alias("h"))
    sizes = [r["count"] for r in radix(near, "h", 100).groupBy("part").count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 3000
    monkeypatch.setattr(frequency, "shared_dir", lambda s: "hdfs://name/folder")
    assert frequency.spill_dir(spark) == ""
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path}/a,{tmp_path}/b")
    assert frequency._spill_here("").startswith(f"{tmp_path}/a/")
    spark.conf.set(frequency.SPILL_SETTING, str(tmp_path / "own"))
    try:
        assert frequency.spill_dir(spark) == str(tmp_path / "own")
        rows = spark.range(60_000).select(F.lit("x").alias("field_name"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.repeat(F.col("id").cast("string"), F.lit(20))).alias("term"), F.col("id").cast("string").alias("file_id"), F.lit(2).alias("n"))
        got = term_counts(rows, memory="24MB")
        assert got.count() == 40_001 and got.where("term = 'hot'").first()[2:] == (40_000, 20_000)
        assert not any((tmp_path / "own").rglob("*.tmp"))
    finally:
        spark.conf.unset(frequency.SPILL_SETTING)
