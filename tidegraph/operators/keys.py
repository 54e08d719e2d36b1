"""Per-key results where a few keys hold most rows.

The work is done by map-side combining in two levels of native algebraic aggregates. Each row
becomes the mergeable states (key, kind, value) -> count. Spark's hash aggregate combines them in a
bounded table per partition, which spills, before the first shuffle; that shuffle is by the whole
state, so the states of one hot key lie on all partitions. The second level merges them to one
compact row per key and partition before it shuffles by key. No task ever sees the rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def key_profile(
    df: DataFrame,
    sides: dict[str, tuple[str, str]],
    value: str,
    count_name: str = "n_rows",
    partner_name: str = "n_partners",
    value_name: str = "n_values",
) -> DataFrame:
    """Rows, distinct partners and distinct values of each key on each side.

    sides: name of the side -> (key column, partner column). Result: side, entity, ``count_name``,
    ``partner_name``, ``value_name``.

    Null keys are kept as one row with a null entity, empty keys as one with an empty one; the
    caller leaves them out as needed. Null and empty partners and null values count as no partner
    and no value. Repeated rows count as often as they come. An empty table gives no rows. Columns
    of ``df`` that aren't named play no part, whatever their names.
    """
    rows = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(side).alias("side"), F.col(key).alias("entity"), F.col(partner).alias("partner"))
                    for side, (key, partner) in sides.items()
                ]
            )
        ).alias("s"),
        F.col(value).alias("value"),
    ).select("s.side", "s.entity", blank_to_null(F.col("s.partner")).alias("partner"), "value")
    pairs = rows.groupBy("side", "entity", "partner", "value").agg(F.count("*").alias("n"))
    states = pairs.select(
        "side",
        "entity",
        F.explode(
            F.array(
                F.struct(F.lit("p").alias("kind"), F.col("partner").alias("v"), F.col("n").alias("n")),
                F.struct(F.lit("v").alias("kind"), F.col("value").alias("v"), F.lit(0).cast("long").alias("n")),
            )
        ).alias("x"),
    ).select("side", "entity", "x.kind", "x.v", "x.n")
    merged = states.groupBy("side", "entity", "kind", "v").agg(F.sum("n").alias("n"))
    return merged.groupBy("side", "entity").agg(
        F.sum("n").alias(count_name),
        F.count_if((F.col("kind") == "p") & F.col("v").isNotNull()).alias(partner_name),
        F.count_if((F.col("kind") == "v") & F.col("v").isNotNull()).alias(value_name),
    )


def hot_keys(profile: DataFrame, total: Column, share_inverse: int, count_name: str = "n_rows") -> DataFrame:
    """The non-empty keys of a profile that hold at least 1/share_inverse of ``total`` rows."""
    return profile.where(
        F.col("entity").isNotNull() & (F.col("entity") != "") & (F.col(count_name) * share_inverse >= total)
    ).select("side", "entity")
