"""The dependency climb: which tokens are sources and targets of which verb.

A sentence is one array of tokens; all climbs are higher-order functions over it, bounded like the
climbs they match. There is one shuffle, by sentence, which the later windows over sentences reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph import schemas as S


def _in(c: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def sentences(tokens: DataFrame) -> DataFrame:
    """One row per sentence with its tokens ``s``, ordered by token_id.

    A token delivered again counts once; rows without token_id are left out. Ids may have gaps:
    heads are looked up by id, and ``hp`` is the head's place, from 1, or null if it isn't there.
    """
    S.require(tokens, S.TOKEN_COLUMNS, "tokens")
    fields = F.struct(
        F.col("token_id").alias("id"), F.col("head_token_id").alias("head"), "token", "lemma", "pos", "tag", F.col("dep_rel").alias("dep"),
        F.coalesce("entity", F.lit("")).alias("entity"),
    )
    rows = tokens.where(F.col("token_id").isNotNull()).groupBy(*S.SENTENCE).agg(F.array_sort(F.collect_set(fields)).alias("s"))
    ids = rows.select(*S.SENTENCE, "s", F.transform("s", lambda t: t.id).alias("ids"))
    return ids.select(
        *S.SENTENCE,
        F.transform(
            "s",
            lambda t, i: F.struct(
                *[t[n].alias(n) for n in ("id", "head", "token", "lemma", "pos", "tag", "dep", "entity")],
                (i + 1).alias("at"),
                F.nullif(F.array_position(F.col("ids"), t.head).cast("int"), F.lit(0)).alias("hp"),
                _in(t.pos, S.VERBS).alias("verb"),
                (F.coalesce(t.pos == "AUX", F.lit(False)) & _in(t.dep, S.AUXILIARY)).alias("aux"),
                (F.coalesce(t.pos == "VERB", F.lit(False)) & F.coalesce(t.dep == "xcomp", F.lit(False))).alias("x"),
            ),
        ).alias("s"),
    )


def sentence_filter(rows: DataFrame) -> DataFrame:
    """Sentences with a subject, an object and a verb."""
    return rows.where(
        F.exists("s", lambda t: _in(t.dep, S.SUBJECTS)) & F.exists("s", lambda t: _in(t.dep, S.OBJECTS)) & F.exists("s", lambda t: t.verb)
    )


def _at(p: Column) -> Column:
    return F.get(F.col("s"), p - 1)


def _role(t: Column) -> Column:
    """Climbs from a token until a rule holds: (cur, role); role is null if none does."""
    start = F.struct(t.at.alias("cur"), F.lit(None).cast("string").alias("role"))

    def step(acc: Column, _: Column) -> Column:
        def look(e: Column) -> Column:
            role = (
                F.when(e.dep == "appos", "appos")
                .when(e.verb, "target")
                .when(_in(e.dep, S.SUBJECTS), "source")
                .when(F.upper(e.dep) == "ROOT", "root_not_verb")
                .when(e.head == e.id, "broken_dep_rel")
                .when(e.head == t.id, "inf_loop")
            )
            return F.get(
                F.transform(F.array(role), lambda r: F.struct(F.when(r.isNull(), e.hp).otherwise(e["at"]).alias("cur"), r.alias("role"))), F.lit(0)
            )

        return F.when(acc.role.isNotNull() | acc.cur.isNull(), acc).otherwise(F.get(F.transform(F.array(_at(acc.cur)), look), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(S.ROLE_STEPS)), start, step)


def _verb_of(role: Column) -> Column:
    """The place of the verb: the stop itself for targets, the first verb above it for sources."""

    def step(acc: Column, _: Column) -> Column:
        return F.when(acc.done | acc.cur.isNull(), acc).otherwise(
            F.get(
                F.transform(F.array(_at(acc.cur)), lambda e: F.struct(F.when(e.verb, acc.cur).otherwise(e.hp).alias("cur"), e.verb.alias("done"))),
                F.lit(0),
            )
        )

    start = F.struct(role.cur.alias("cur"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(S.VERB_STEPS)), start, step, lambda acc: F.when(acc.done, acc.cur))
    return F.when(role.role == "target", role.cur).when(role.role == "source", found)


def _anchor(t: Column) -> Column:
    """Where an open complement hangs: the head of the topmost of its chain."""

    def step(p: Column, _: Column) -> Column:
        return F.get(F.transform(F.array(_at(p).hp), lambda h: F.when(F.coalesce(_at(h).x, F.lit(False)), h).otherwise(p)), F.lit(0))

    return F.when(t.x, _at(F.aggregate(F.sequence(F.lit(1), F.lit(S.XCOMP_STEPS)), t["at"], step)).hp)


def _empty_to_null(a: Column) -> Column:
    return F.get(F.transform(F.array(a), lambda v: F.when(F.size(v) > 0, v)), F.lit(0))


def crawl(rows: DataFrame) -> DataFrame:
    """``sentences`` with ``c``, an array of what the climb found for each token, in the same order."""
    climbed = rows.withColumn("r", F.transform("s", lambda t: F.struct(_role(t).alias("role"), _anchor(t).alias("anchor"))))
    climbed = climbed.withColumn("v", F.transform("r", lambda r: _verb_of(r.role)))
    # Lists of a token: its helpers; the complements anchored at it; the helpers of the last of them.
    lists = climbed.withColumn(
        "l",
        F.transform(
            "s",
            lambda t: F.struct(
                F.filter("s", lambda e: e.aux & (e.hp == t["at"])).alias("helpers"),
                F.filter("s", lambda e: F.get("r", e["at"] - 1).anchor == t["at"]).alias("complements"),
            ),
        ),
    )
    lists = lists.withColumn(
        "l",
        F.transform(
            "l",
            lambda x: F.struct(
                x.helpers.alias("helpers"),
                F.transform(x.complements, lambda e: e.lemma).alias("xcomp"),
                F.get("l", F.get(x.complements, F.size(x.complements) - 1)["at"] - 1).helpers.alias("xhelpers"),
            ),
        ),
    )

    def found(t: Column) -> Column:
        i = t["at"] - 1
        verb = F.get("v", i)
        anchor = F.when(_at(verb).dep == "xcomp", F.coalesce(F.get("r", verb - 1).anchor, verb))
        # Tokens of an open complement take over what its anchor's row has.
        row = F.when(anchor.isNotNull(), anchor).otherwise(t["at"])

        def final(x: Column) -> Column:
            v = _at(x.verb)
            own = F.get("l", x.row - 1)
            return F.struct(
                F.get("r", i).role.role.alias("role"),
                v.id.alias("verb_id"),
                v.token.alias("verb_name"),
                v.lemma.alias("verb_lemma"),
                v.tag.alias("verb_tense"),
                v.head.alias("parent_id"),
                F.when(F.get("r", i).anchor.isNotNull(), _at(F.get("r", i).anchor).id).alias("x_parent_id"),
                _empty_to_null(F.transform(own.helpers, lambda e: e.lemma)).alias("helper_lemma"),
                _empty_to_null(F.transform(own.helpers, lambda e: e.token)).alias("helper_token"),
                _empty_to_null(F.get("l", i).xcomp).alias("xcomp_verb"),
                _empty_to_null(F.transform(own.xhelpers, lambda e: e.lemma)).alias("xcomp_helper_lemma"),
                _empty_to_null(F.transform(own.xhelpers, lambda e: e.token)).alias("xcomp_helper_token"),
            )

        return F.get(F.transform(F.array(F.struct(F.get("v", row - 1).alias("verb"), row.alias("row"))), final), F.lit(0))

    return lists.withColumn("c", F.transform("s", found)).select(*S.SENTENCE, "s", "c")


def crawled_tokens(tokens: DataFrame, filtered: bool = True) -> DataFrame:
    """The tokens of ``crawl``, one row each. An empty table gives no rows."""
    rows = sentences(tokens)
    rows = crawl(sentence_filter(rows) if filtered else rows)
    z = rows.select(*S.SENTENCE, F.explode(F.arrays_zip("s", "c")).alias("z"))
    return z.select(
        *S.SENTENCE,
        F.col("z.s.id").alias("token_id"),
        *[F.col(f"z.s.{n}").alias(n) for n in ("token", "lemma", "pos", "tag")],
        F.col("z.s.head").alias("head_token_id"),
        F.col("z.s.dep").alias("dep_rel"),
        F.col("z.s.entity").alias("entity"),
        "z.c.*",
    )
