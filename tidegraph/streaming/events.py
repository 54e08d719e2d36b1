"""The same operators over streams.

The climb over a sentence needs nothing but the sentence, so a stream whose rows hold whole sentences
runs through it without state. Counts by time use event-time windows and a watermark, so that late
rows within the delay still count and state is dropped behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import schemas as S
from tidegraph.operators.crawl import crawl, sentence_filter
from tidegraph.session import scratch


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files under ``path``, or of that file, with the schema they have."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        folder, _, name = path.rstrip("/").rpartition("/")  # the file source lists folders
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def crawl_stream(rows: DataFrame) -> DataFrame:
    """Roles and verbs of a stream of sentences (file_id, doc_id, sentence_id, s), ``s`` as
    ``operators.crawl.sentences`` makes it. Stateless: one row in, one row per token out."""
    found = crawl(sentence_filter(rows)).select(*S.SENTENCE, F.explode(F.arrays_zip("s", "c")).alias("z"))
    return found.select(*S.SENTENCE, F.col("z.s.id").alias("token_id"), F.col("z.c.role").alias("role"), F.col("z.c.verb_id").alias("verb_id"))


def windowed_counts(rows: DataFrame, time: str, key: str, window: str = "30 days", delay: str = "90 days") -> DataFrame:
    """(window_start, ``key``, n): rows per key and window of event time. Rows with a null time are
    left out; null keys count as a key. Unless the output mode is ``complete``, rows that come later than ``delay``
    behind the newest are left out, and the state of their windows is dropped."""
    return (
        rows.where(F.col(time).isNotNull())
        .withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), key, "n")
    )


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now and gives its last result. The sink keeps each batch's
    rows in the shared folder; the query's checkpoint lies there too."""
    spark = stream.sparkSession
    out = scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
