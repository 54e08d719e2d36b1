"""Rewriting entity names by rules.

Rules are few (hundreds to thousands) and written by people: they're checked, their cycles broken
and their chains resolved on the driver. Names may be any number: rules reach them as a join on the
exact name, or, for partial rules, as a fold of expressions.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEADING_THE = r"^(?:The|the|THE)_"
#: Rules up to which they're broadcast.
SMALL_RULES = 100_000


@dataclass
class Rules:
    """Compiled rules. exact: from -> to, chains that one pass in order runs through resolved if recursive; many:
    from -> several; partial: (from, to) in order; passes: how often all are applied."""

    exact: dict[str, str] = field(default_factory=dict)
    many: dict[str, list[str]] = field(default_factory=dict)
    partial: list[tuple[str, str]] = field(default_factory=list)
    passes: int = 1
    concatenator: str = "_"

    @property
    def targets(self) -> set[str]:
        return set(self.exact.values()) | {t for ts in self.many.values() for t in ts} | {t for _, t in self.partial}


def compile_rules(
    origin: Sequence[str | Sequence[str]], target: Sequence[str | Sequence[str]], partial: bool | Sequence[bool] = False, recursive: bool = True, concatenator: str = "_"
) -> Rules:
    """Checks and compiles rules.

    Errors: unequal lengths; several names to rewrite in one rule; several targets of a partial
    rule; one name in two rules. Warnings: a partial rule whose target holds its origin becomes exact;
    a rule that changes nothing is left out; the rule that closes a cycle is left out; partial rules
    whose targets hold each other's origins in a circle become exact. With ``recursive`` a name that
    a rule gives is rewritten again; without it, each original name once.
    """
    if isinstance(origin, str) or isinstance(target, str) or len(origin) != len(target):
        raise ValueError("origin and target must be lists of equal length")
    flags = [partial] * len(origin) if isinstance(partial, bool) else list(partial)
    if len(flags) != len(origin):
        raise ValueError("match_partial must be one value or one per rule")
    rules: list[tuple[str, list[str], bool]] = []
    for a, b, p in zip(origin, target, flags, strict=True):
        if not isinstance(a, str):
            if len(a) != 1:
                raise ValueError("a rule can rewrite only one name")
            a = a[0]
        b = [b] if isinstance(b, str) else list(b)
        if p and len(b) > 1:
            raise ValueError(f"{a}: a partial rule can have only one target")
        a, b = re.sub(LEADING_THE, "", a), [re.sub(LEADING_THE, "", x) for x in b]
        if b == [a]:
            warnings.warn(f"{a}: the rule changes nothing and is left out", stacklevel=2)
            continue
        if p and a in b[0]:
            warnings.warn(f"{a}: its target holds it, so it is matched whole", stacklevel=2)
            p = False
        rules.append((a, b, p))
    names = [a for a, _, _ in rules]
    if len(set(names)) != len(names):
        raise ValueError("duplicate names to rewrite: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    step = {a: b for a, b, _ in rules}
    dropped: set[str] = set()
    for a in names:  # in the order of the rules, the one that leads back is dropped
        stack, seen = [(a, a)], {a}
        while stack:
            via, x = stack.pop()
            for y in step.get(x, []):
                if x in dropped:
                    continue
                if y == a:
                    warnings.warn(f"{x}: the rule closes a cycle and is left out", stacklevel=2)
                    dropped.add(x)
                elif y not in seen:
                    seen.add(y)
                    stack.append((via, y))
    rules = [r for r in rules if r[0] not in dropped]
    if circle := _circles(rules):
        warnings.warn(", ".join(sorted(circle)) + ": the rules lead to each other by partial matches and are matched whole", stacklevel=2)
        rules = [(a, b, p and a not in circle) for a, b, p in rules]
    out = Rules(concatenator=concatenator)
    for a, b, p in rules:
        if p:
            out.partial.append((a, b[0]))
        elif len(b) > 1:
            out.many[a] = b
        else:
            out.exact[a] = b[0]
    if recursive:
        # One pass applies exact rules in order: a name runs on to later rules, to earlier ones in the next pass.
        at = {a: i for i, a in enumerate(out.exact)}
        for a in reversed(list(out.exact)):
            if at.get(out.exact[a], -1) > at[a]:
                out.exact[a] = out.exact[out.exact[a]]
        out.passes = max(1, _longest({a: b for a, b, _ in rules}))
    return out


def _circles(rules: list[tuple[str, list[str], bool]]) -> set[str]:
    """Origins of partial rules that lead to each other: a rule leads to the partial rules whose origin its target holds."""
    step = {a: [x for x, _, p in rules if p and any(re.search(x, t) for t in b)] for a, b, _ in rules}
    out = set()
    for a, _, p in rules:
        stack, seen = list(step[a]) if p else [], set()
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += step[x]
        if a in seen:
            out.add(a)
    return out


def _longest(step: dict[str, list[str]]) -> int:
    """Rules in the longest chain."""
    known: dict[str, int] = {}
    for a in step:
        stack = [a]
        while stack:
            x = stack[-1]
            open_ = [y for y in step.get(x, []) if y in step and y not in known]
            if open_:
                stack += open_
            else:
                known[x] = 1 + max((known[y] for y in step.get(x, []) if y in step), default=0)
                stack.pop()
    return max(known.values(), default=0)


def _quoted(to: str) -> str:
    """A replacement for Java: $ and \\ stand for themselves."""
    return re.sub(r"[\\$]", lambda m: "\\" + m[0], to)


def partial_column(c: Column, rules: Rules) -> Column:
    """All partial rules in order: at the beginning, within, then whole. Origins are expressions."""
    s = rules.concatenator
    for a, b in rules.partial:
        c = F.regexp_replace(c, f"^{a}{s}", _quoted(b + s))
    for a, b in rules.partial:
        c = F.regexp_replace(c, f"{s}{a}", _quoted(s + b))
    for a, b in rules.partial:
        c = F.regexp_replace(c, f"^{a}$", _quoted(b))
    return c


def partial_hit(c: Column, rules: Rules) -> Column:
    """Whether one of the partial rules matches."""
    k = rules.concatenator
    return c.rlike("|".join(f"^{a}{k}|{k}{a}|^{a}$" for a, _ in rules.partial)) if rules.partial else F.lit(False)


def _lookup(df: DataFrame, column: str, known: dict[str, list[str]]) -> DataFrame:
    """``df`` with __to: what ``known`` has for the column, or null. Rules are written by people: up to
    ``SMALL_RULES`` they're broadcast, beyond it joined by shuffle."""
    table = df.sparkSession.createDataFrame([(a, b) for a, b in known.items()], "__from string, __to array<string>")
    return df.join(F.broadcast(table) if len(known) <= SMALL_RULES else table, df[column] == F.col("__from"), "left").drop("__from")


def rewrite(df: DataFrame, column: str, rules: Rules, try_drop: str | None = None) -> DataFrame:
    """``df`` with the names in ``column`` rewritten; a rule with several targets multiplies rows.

    A pass applies the rules with several targets, then all partial rules, then the exact ones: an exact rule
    sees what partial ones left. ``try_drop``: an expression; a name that no rule of the pass matches is tried without
    it: if a rule matches then, its result is taken, and if the bare name is a rule's target, the bare name.
    Null names stay null.
    """
    df = df.withColumn(column, F.regexp_replace(column, LEADING_THE, ""))
    c, bare = F.col(column), F.col("__bare")
    exact = {a: [b] for a, b in rules.exact.items()}
    for _ in range(rules.passes):
        hit = F.lit(False)
        if rules.many:
            df = _lookup(df, column, rules.many).withColumn("__hit", F.col("__to").isNotNull()).withColumn(column, F.explode(F.coalesce("__to", F.array(c)))).drop("__to")
            hit = F.col("__hit")
        df = df.withColumn("__hit", F.coalesce(hit | partial_hit(c, rules), F.lit(False)))
        if rules.partial:
            df = df.withColumn(column, partial_column(c, rules))
        if exact:
            df = _lookup(df, column, exact).withColumns({"__hit": F.col("__hit") | F.col("__to").isNotNull(), column: F.coalesce(F.get("__to", F.lit(0)), c)}).drop("__to")
        if try_drop:
            # Names that no rule matched, with what is to be dropped, are rewritten without it.
            tried = ~F.col("__hit") & c.rlike(try_drop)
            df = df.withColumn("__bare", F.when(tried, F.nullif(F.regexp_replace(c, try_drop, ""), F.lit(""))))
            if rules.many:
                df = _lookup(df, "__bare", rules.many).withColumnRenamed("__to", "__many")
            df = df.withColumns({"__fits": partial_hit(bare, rules), "__bare": partial_column(bare, rules) if rules.partial else bare})
            targets = {t: [t] for t in sorted(rules.targets)}
            df = _lookup(df, "__bare", targets | exact)
            new = F.coalesce(F.get("__to", F.lit(0)), F.when(F.col("__fits"), bare), c)
            several = F.coalesce("__many", F.array(new)) if rules.many else F.array(new)
            df = df.withColumn(column, F.explode(several)).drop("__bare", "__fits", "__to", "__many")
        df = df.drop("__hit")
    return df


def disambiguate(
    nodes: DataFrame, edges: DataFrame, rules: Rules, try_drop: str | None = None, key: str = "graph_id", verb: str = "doc_sent_verb", keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges under the rules.

    Both ends are rewritten, and multiplied by rules with several targets; names end in lower case
    without a leading "the_". With ``try_drop``, a name that becomes a node's name without it is
    merged into that node. Nodes of one name and graph are merged: appearances are summed, the type is
    that of the row with most, further columns in ``keep`` their first value there is. Empty names
    become null; nameless nodes are left out; edgeiscomplete is renewed, and of a verb with a
    complete edge only complete ones stay.
    """

    def final(c: str) -> Column:
        return F.nullif(F.regexp_replace(F.lower(c), "^the_", ""), F.lit(""))

    n = rewrite(nodes, "entity_name", rules, try_drop).withColumn("entity_name", final("entity_name"))
    e = rewrite(rewrite(edges, "source", rules, try_drop), "target", rules, try_drop)
    e = e.withColumns({"source": final("source"), "target": final("target")})
    if try_drop:
        present = n.select(key, F.col("entity_name").alias("__node")).where(F.col("__node").isNotNull()).distinct()

        def merged(df: DataFrame, c: str) -> DataFrame:
            bare = df.withColumn("__bare", F.regexp_replace(c, try_drop.lower(), ""))
            hit = present.withColumnRenamed("__node", "__bare").withColumn("__hit", F.lit(True))
            return bare.join(hit, [key, "__bare"], "left").withColumn(c, F.when(F.col("__hit"), F.col("__bare")).otherwise(F.col(c))).drop("__bare", "__hit")

        n, e = merged(n, "entity_name"), merged(merged(e, "source"), "target")
    order = F.struct(-F.coalesce("num_appearances", F.lit(0)), F.col("entity_type").isNull(), "entity_type")
    n = (
        n.where(F.col("entity_name").isNotNull())
        .groupBy(key, "entity_name")
        .agg(
            F.min_by("entity_type", order).alias("entity_type"),
            F.sum(F.coalesce("num_appearances", F.lit(0))).alias("num_appearances"),
            *[F.min_by(c, F.struct(F.col(c).isNull(), order)).alias(c) for c in keep],
        )
    )
    e = e.withColumn("edgeiscomplete", F.col("source").isNotNull() & F.col("target").isNotNull())
    complete = F.bool_or("edgeiscomplete").over(W.partitionBy(key, verb))
    e = e.withColumn("__c", complete).where(F.col("edgeiscomplete") | ~F.col("__c")).drop("__c")
    return n, e
