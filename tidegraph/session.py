"""Session-level helpers: reading the input tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a side of a join up to which it is broadcast, and rows of a key from which it is joined apart.
SMALL_SIDE, HEAVY_KEY = 200_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is the cluster's spark.checkpoint.dir; only where
    that is unset (tests on one machine) a local folder is made and set."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    path = "file://" + os.path.join(tempfile.gettempdir(), f"tidegraph-{os.getpid()}")
    context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of ``df`` with a reliable checkpoint in the shared folder, so that what
    follows survives the loss of an executor and isn't computed twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """``cut`` for tables that come from themselves again and again. A checkpoint keeps the planner's estimate of its
    size, which a join multiplies; after some rounds the estimates have millions of digits and planning
    doesn't end. This one has no estimate, and the adaptive planner goes by real sizes."""
    done = cut(df)
    try:
        plain = df.sparkSession._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    except Exception:  # not a session in this process: the estimate stays
        return done
    return DataFrame(plain, df.sparkSession)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hint_small(df: DataFrame, rows_limit: int, rows: int | None = None) -> DataFrame:
    """Marks ``df`` for broadcast if it has at most ``rows_limit`` rows, else leaves the join to
    the planner's shuffle joins. ``rows`` saves the count where it is known."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= rows_limit else df


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """``rows`` left join ``one``, which has at most one row per ``keys``, however many rows share a key.

    ``one`` is broadcast up to ``SMALL_SIDE`` rows (size: their number or a bound of it, if known). Beyond it the keys that
    more than ``HEAVY_KEY`` rows have are joined apart: they're at most rows / ``HEAVY_KEY``, so their side is broadcast where
    it is small, and no task gets all rows of such a key. Null keys meet nothing.
    """
    if (one.count() if size is None else size) <= SMALL_SIDE:
        return rows.join(F.broadcast(one), keys, "left")
    heavy = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > HEAVY_KEY).select(*keys, F.lit(True).alias("__heavy")))
    n = heavy.count()
    if not n:
        return rows.join(one, keys, "left")
    flagged = rows.join(hint_small(heavy, SMALL_SIDE, n), keys, "left")
    hot = one.join(hint_small(heavy.drop("__heavy"), SMALL_SIDE, n), keys, "left_semi")
    apart = flagged.where("__heavy").drop("__heavy").join(hint_small(hot, SMALL_SIDE, n), keys, "left")
    return flagged.where("__heavy is null").drop("__heavy").join(one, keys, "left").unionByName(apart)
