"""Acronyms defined in brackets or in two-column tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CAPITALS = r"\b[A-Z]+\b"


def _name_pattern(acronym: Column) -> Column:
    """The letters of an acronym as the capitals of a name."""
    return F.concat(F.array_join(F.split(acronym, ""), r"[\s|a-z]+"), F.lit("[a-z]+"))


def _last(text: Column, pattern: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, pattern, F.lit(0)), F.lit(-1))


def parenthetical(pages: DataFrame, text: str = "text") -> DataFrame:
    """(name, acronym): "Full Name (FN)" and "FN (Full Name)". Names come with underscores.

    An acronym of one letter doesn't count; one with several names is left out. Null and empty texts
    give nothing. The ambiguity is decided after the distinct pairs, which are few, whatever the
    number of pages.
    """
    piece = pages.select(F.explode(F.split(text, r"\)")).alias("piece")).select(F.split("piece", r"\(").alias("p")).where(F.size("p") == 2)
    parts = piece.select(F.get("p", F.lit(0)).alias("before"), F.get("p", F.lit(1)).alias("inside"))
    before = parts.select("inside", _last(F.col("before"), F.lit(_CAPITALS)).alias("acronym")).where(F.length("acronym") > 1)
    inside = parts.select("before", F.explode(F.regexp_extract_all("inside", F.lit(_CAPITALS), F.lit(0))).alias("acronym")).where(F.length("acronym") > 1)
    both = before.select(_last(F.col("inside"), _name_pattern(F.col("acronym"))).alias("name"), "acronym").unionByName(
        inside.select(_last(F.col("before"), _name_pattern(F.col("acronym"))).alias("name"), "acronym")
    )
    named = both.where(F.col("name").isNotNull()).select(F.regexp_replace("name", r"-|\s+", "_").alias("name"), "acronym").distinct()
    single = named.groupBy("acronym").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    return single.where(F.col("n") == 1).select("name", "acronym")


def tabular(pages: DataFrame, text: str = "text") -> DataFrame:
    """(name, acronym) from lines of exactly two cells, wide gaps between them, of which one is
    the other without small letters, blanks and underscores."""
    line = pages.select(F.explode(F.split(text, r"\n")).alias("line")).select(F.filter(F.split("line", r"\s\s+"), lambda x: x != "").alias("c")).where(F.size("c") == 2)
    cells = line.select(F.get("c", F.lit(0)).alias("a"), F.get("c", F.lit(1)).alias("b"))

    def stands_for(short: str, long: str) -> Column:
        return (F.col(short) == F.regexp_replace(long, r"[a-z]|_|\s", "")) & F.col(long).rlike("[a-z]") & F.col(short).rlike("[A-Z]")

    pair = F.when(stands_for("a", "b"), F.struct(F.col("b").alias("name"), F.col("a").alias("acronym"))).when(
        stands_for("b", "a"), F.struct(F.col("a").alias("name"), F.col("b").alias("acronym"))
    )
    found = cells.select(pair.alias("x")).where(F.col("x").isNotNull() & (F.length("x.acronym") > 1))
    return found.select(F.regexp_replace("x.name", r"(?U)\W", "_").alias("name"), F.regexp_replace("x.acronym", r"(?U)\W", "_").alias("acronym")).distinct()


def find_acronyms(pages: DataFrame, text: str = "text", tables: DataFrame | None = None) -> DataFrame:
    """Both kinds; what brackets define goes before tables, and of several names in tables the first
    in the alphabet is taken."""
    found = parenthetical(pages, text)
    if tables is None:
        return found
    both = found.withColumn("p", F.lit(0)).unionByName(tabular(tables, text).withColumn("p", F.lit(1)))
    first = W.partitionBy("acronym").orderBy("p", "name")
    return both.withColumn("r", F.row_number().over(first)).where("r = 1").select("name", "acronym")
