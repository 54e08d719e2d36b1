"""Verb class records as flat tables (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.xmljson import xml_column
from tidegraph.operators.nested import Shape, flatten, infer_shape
from tidegraph.session import cut, table

CLASSES = ("VNCLASS", "VNSUBCLASS")
#: The elements on the way from a record to its members and subclasses.
SPINE = (*CLASSES, "SUBCLASSES", "MEMBERS", "MEMBER")


def _records(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] | None) -> DataFrame:
    """One row per record with its JSON. A redelivered record counts once. Parsed once: the result
    is cut, because both the inference and every table read it."""
    raw = table(spark, sf_dir, "vnclass").select("record_id", "record_xml").distinct()
    return cut(raw.select("record_id", xml_column(F.col("record_xml"), keep).alias("json")).where(F.col("json").isNotNull()))


def _with(df: DataFrame, *names: str) -> DataFrame:
    """Adds attributes that no record has as nulls."""
    return df.select("*", *[F.lit(None).cast("string").alias(n) for n in names if n not in df.columns])


def _classes(flat: dict[str, DataFrame]) -> DataFrame | None:
    """record_id, node, class_id, around: the surrogate key of the class around it."""
    parts = [
        _with(flat[t], "@ID").select("record_id", "node", F.coalesce("@ID", F.lit("")).alias("class_id"), "parent", "ordinal", F.lit(t).alias("element"))
        for t in CLASSES
        if t in flat
    ]
    if not parts:
        return None
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    # A surrogate key is the path of its ancestors' keys; the last class on it is the class around.
    pattern = r"^(.*(?:^|\.)(?:VNSUBCLASS|VNCLASS)\.\d+)(?:\.SUBCLASSES\.\d+)?$"
    return both.select("*", F.nullif(F.regexp_extract(F.coalesce("parent", F.lit("")), pattern, 1), F.lit("")).alias("around"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = _records(spark, sf_dir, SPINE)
    flat = flatten(records, "record_id", "json", infer_shape(records, "json"), {*CLASSES, "MEMBER"})
    classes, members = _classes(flat), flat.get("MEMBER")
    if classes is None:
        classes = spark.createDataFrame([], "record_id long, node string, class_id string, parent string, ordinal int, element string, around string")
    up = classes.select("record_id", F.col("node").alias("around"), F.col("class_id").alias("around_id"))
    linked = classes.join(up, ["record_id", "around"], "left").select(
        "record_id",
        "node",
        "class_id",
        F.when(F.col("element") == "VNCLASS", F.lit("")).otherwise(F.coalesce("around_id", F.lit(""))).alias("parent_id"),
        "ordinal",
    )
    if members is None:
        members = spark.createDataFrame([], "record_id long, node string, parent string, parent_table string, ordinal int")
    return linked, _with(members, "@name", "@wn", "@grouping")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class of every well-formed record with the class around it and its place there."""
    return _tables(spark, sf_dir)[0].select("record_id", "class_id", "parent_id", "ordinal")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, members = _tables(spark, sf_dir)
    owner = F.regexp_extract(F.col("parent"), r"^(.*(?:^|\.)(?:VNSUBCLASS|VNCLASS)\.\d+)\.MEMBERS\.\d+$", 1)
    return members.where(F.col("parent_table") == "MEMBERS").select(
        "record_id", owner.alias("node"), "ordinal", F.col("@name").alias("name"), F.col("@wn").alias("wn"), F.col("@grouping").alias("grouping")
    ).join(classes.drop("ordinal"), ["record_id", "node"])


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member with its class, its place there and its other attributes (null where absent)."""
    return _members(spark, sf_dir).select("record_id", "class_id", "parent_id", "ordinal", "name", "wn", "grouping")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members directly in a class; members without a name are left out."""
    return _members(spark, sf_dir).where(F.col("name").isNotNull()).select("record_id", "class_id", "parent_id", "name").distinct()


def p6_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole records flattened: rows and distinct parents of every table, all levels stacked."""
    records = _records(spark, sf_dir, None)
    shape: Shape = infer_shape(records, "json")
    parts = [
        df.select(F.lit(name).alias("element"), "record_id", "parent")
        for name, df in sorted(flatten(records, "record_id", "json", shape).items())
    ]
    if not parts:
        return spark.createDataFrame([], "element string, n_rows long, n_records long, n_parents long")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    per_parent = both.groupBy("element", "record_id", "parent").agg(F.count("*").alias("n"))
    per_record = per_parent.groupBy("element", "record_id").agg(F.sum("n").alias("n"), F.count("*").alias("p"))
    return per_record.groupBy("element").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_records"), F.sum("p").alias("n_parents"))


QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes, "p6_members": p6_members, "p6_elements": p6_elements}
#: DuckDB reads no XML; the tests hold these against an XML tree.
ORACLE: dict[str, str] = {}
