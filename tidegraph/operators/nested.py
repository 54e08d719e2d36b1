"""Deeply nested records as related flat tables that keep parent-child links.

A first pass infers one schema merged over all records (``schema_of_variant_agg``, an aggregate with
map-side partials; only the schema comes to the driver). The second walks that schema: within a record, the
objects of each array level are taken out of the objects of the level above, with the parent's surrogate key
and the ordinal in the array; then all that a table holds is exploded at once. So there is one pass over a
record and one explosion a table, however deep the schema is, and recursive types of any depth end in one table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.session import cut


#: Tables up to which each is read from the records by itself; for more, all objects are written once, each with what it holds.
SHARED = 4


@dataclass
class Shape:
    """One object level of a merged schema: its scalar fields and its arrays of objects."""

    scalars: dict[str, str] = field(default_factory=dict)
    arrays: dict[str, "Shape"] = field(default_factory=dict)


def parse_shape(schema: str) -> Shape:
    """Reads what ``schema_of_variant_agg`` gives: OBJECT<a: STRING, b: ARRAY<OBJECT<...>>>."""
    at = 0

    def eat(s: str) -> None:
        nonlocal at
        if not schema.startswith(s, at):
            raise ValueError(f"expected {s!r} at {at} of the schema")
        at += len(s)

    def name() -> str:
        nonlocal at
        if schema[at] == "`":
            end = at + 1
            while True:
                end = schema.index("`", end)
                if schema[end + 1 : end + 2] != "`":
                    break
                end += 2
            got, at = schema[at + 1 : end].replace("``", "`"), end + 1
            return got
        end = schema.index(":", at)
        got, at = schema[at:end], end
        return got

    def value() -> Shape | str:
        nonlocal at
        if schema.startswith("OBJECT<", at):
            eat("OBJECT<")
            shape = Shape()
            while schema[at] != ">":
                key = name()
                eat(": ")
                got = value()
                if isinstance(got, Shape):
                    shape.arrays[key] = got
                else:
                    shape.scalars[key] = got
                if schema[at] == ",":
                    eat(", ")
            eat(">")
            return shape
        if schema.startswith("ARRAY<", at):
            eat("ARRAY<")
            got = value()
            eat(">")
            return got if isinstance(got, Shape) else f"array<{got}>"
        end, deep = at, 0
        while end < len(schema) and (deep or schema[end] not in ",>"):
            deep += {"(": 1, ")": -1}.get(schema[end], 0)
            end += 1
        got, at = schema[at:end], end
        return got

    got = value() if schema else Shape()
    return got if isinstance(got, Shape) else Shape()


def infer_shape(records: DataFrame, json: str) -> Shape:
    """The schema merged over all records of the JSON column; empty for an empty table."""
    row = records.agg(F.schema_of_variant_agg(F.parse_json(json)).alias("s")).first()
    return parse_shape(row.s or "")


def depth(shape: Shape) -> int:
    return 1 + max(map(depth, shape.arrays.values()), default=0)


def _path(key: str) -> str:
    return "$[" + "'" + key.replace("'", "\\'") + "'" + "]"


def flatten(records: DataFrame, key: str, json: str, shape: Shape | None = None, tables: set[str] | None = None) -> dict[str, DataFrame]:
    """Child tables by array name, each (``key``, node, parent, parent_table, ordinal, its scalars).

    node and parent are surrogate keys: the record's position path, such as ``0.2.1``; the pair
    (``key``, node) names a row of a table, and (``key``, parent) that of its parent table. Rows
    directly in the record have a null parent. Records with null JSON give no rows; optional fields
    are null where absent; a table that no record holds is left out of the result. ``tables``
    restricts what is returned, not what is walked. Repeated records give repeated rows. ``key`` may
    be null or repeated, but links hold within a record only if it is unique.
    """
    shape = infer_shape(records, json) if shape is None else shape
    scalars: dict[str, dict[str, None]] = {}
    shapes = [shape]
    while shapes:
        for x in shapes:
            for name, sub in x.arrays.items():
                scalars.setdefault(name, {}).update(dict.fromkeys(sub.scalars))
        shapes = [sub for x in shapes for sub in x.arrays.values()]
    none = F.lit(None).cast("string")
    top = records.where(F.col(json).isNotNull()).select(key, F.array(F.struct(none.alias("node"), none.alias("table"), F.parse_json(json).alias("v"))).alias("l0"))
    asked = [name for name in scalars if tables is None or name in tables]
    nodes = cut(_nodes(top, key, _ways(shape, None), None)) if len(asked) > SHARED else None
    flat: dict[str, DataFrame] = {}
    for name in asked:
        rows = _nodes(top, key, _ways(shape, name), name) if nodes is None else nodes.where(F.col("x.table") == name)
        flat[name] = rows.select(
            key, "x.node", "x.parent", "x.parent_table", "x.ordinal", *[F.variant_get("x.v", _path(s), "string").alias(s) for s in scalars[name]]
        )
    return flat


def _nodes(top: DataFrame, key: str, levels: list[list[str]], name: str | None) -> DataFrame:
    """(``key``, x): the objects of all levels, or those of one table."""
    for i, names in enumerate(levels):
        top = top.withColumn(f"l{i + 1}", _children(F.col(f"l{i}"), names))
    held = [F.col(f"l{i + 1}") if name is None else F.filter(f"l{i + 1}", lambda x: x.table == name) for i, names in enumerate(levels) if name is None or name in names]
    return top.select(key, F.explode(F.concat(*held)).alias("x"))


def _ways(shape: Shape, name: str | None) -> list[list[str]]:
    """By level, the arrays ``name`` and those that lead to one; all arrays for None."""

    def leads(x: Shape) -> bool:
        return bool(x.arrays) if name is None else name in x.arrays or any(map(leads, x.arrays.values()))

    out, shapes = [], [shape]
    while any(map(leads, shapes)):
        out.append(list(dict.fromkeys(n for x in shapes for n, sub in x.arrays.items() if name is None or n == name or leads(sub))))
        shapes = [sub for x in shapes for sub in x.arrays.values()]
    return out


def _children(level: Column, names: list[str]) -> Column:
    """The objects in the arrays ``names`` of a level's objects."""

    def of(p: Column, name: str) -> Column:
        return F.transform(
            F.variant_get(p.v, _path(name), "array<variant>"),
            lambda x, i: F.struct(
                F.concat_ws(".", p.node, F.lit(name), i.cast("string")).alias("node"), p.node.alias("parent"), p.table.alias("parent_table"),
                F.lit(name).alias("table"), i.alias("ordinal"), x.alias("v"),
            ),
        )

    return F.flatten(F.transform(level, lambda p: F.flatten(F.filter(F.array(*[of(p, n) for n in names]), lambda a: a.isNotNull()))))
