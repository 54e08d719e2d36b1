"""Tokens to a typed, directed, multiplex event network."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph import schemas as S
from tidegraph.functions.entities import clean_entities, entity_iob, entity_type
from tidegraph.operators.crawl import crawled_tokens
from tidegraph.session import cut

VERB_KEY = [*S.SENTENCE, "verb_id"]
LISTS = ["helper_lemma", "helper_token", "xcomp_verb", "xcomp_helper_lemma", "xcomp_helper_token"]
EDGE_COLUMNS = ["source", "target", "head_verb_name", "head_verb_lemma", "head_verb_tense", *LISTS, "neg", "edgeiscomplete", "has_hedge", "is_future", "doc_sent_verb"]


@dataclass
class Extract:
    """The four tables of a corpus; each file_id is one extract."""

    nodes: DataFrame
    edges: DataFrame
    verbs: DataFrame
    appositives: DataFrame


def consolidate(tokens: DataFrame, concatenator: str = "_", remove: Sequence[str] | None = None) -> DataFrame:
    """Adds entity_type, iob, entity_id and entity_name to crawled tokens.

    A B tag or no tag begins a new entity; an I tag goes on, also without a B before it. Tokens of
    one entity and one role are joined in order. Null tags count as none. ``remove``: expressions
    taken out of entity tokens, which lose their tag by it.
    """
    if remove:
        pattern = "|".join(remove)
        hit = (F.col("entity") != "") & F.col("token").rlike(pattern)
        tokens = tokens.withColumns(
            {"token": F.when(hit, F.regexp_replace("token", pattern, "")).otherwise(F.col("token")), "entity": F.when(hit, "").otherwise(F.col("entity"))}
        )
    t = tokens.withColumn("entity", F.coalesce("entity", F.lit("")))
    t = t.withColumns({"entity_type": entity_type(F.col("entity")), "iob": entity_iob(F.col("entity"))})
    running = W.partitionBy(*S.SENTENCE).orderBy("token_id").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("entity_id", F.sum(F.when(F.col("iob").isin("B", ""), 1).otherwise(0)).over(running))
    group = W.partitionBy(*S.SENTENCE, "entity_id", "role")
    ordered = F.array_sort(F.collect_list(F.struct("token_id", "token")).over(group))
    tagged = F.col("entity") != ""
    return t.withColumns(
        {
            "entity_name": F.when(tagged, F.array_join(F.transform(ordered, lambda x: x.token), concatenator)).otherwise(""),
            "entity_id": F.when(tagged, F.col("entity_id")).otherwise(-1),
        }
    )


def entity_tokens(tokens: DataFrame, keep: Sequence[str] = S.DEFAULT_TYPES, concatenator: str = "_") -> DataFrame:
    """Crawled, consolidated tokens with clean names. Numbers stay names if a type of numbers is kept."""
    t = consolidate(crawled_tokens(tokens), concatenator)
    return t.withColumn("entity_name", clean_entities(F.col("entity_name"), not set(keep) & set(S.NUMERIC_TYPES), True, concatenator))


def appositives(t: DataFrame, keep: Sequence[str] = S.DEFAULT_TYPES) -> DataFrame:
    """(file_id, abbrev, fullname): entities in apposition and what they stand beside. The anchor is
    the first token whose head is outside of the entity."""
    a = t.where((F.col("role") == "appos") & (F.col("entity_name") != "") & F.col("entity_type").isin(*keep))
    group = W.partitionBy(*S.SENTENCE, "entity_id")
    a = a.withColumns({"inside": F.collect_set("token_id").over(group), "first": F.min(F.struct("token_id", "entity_name")).over(group)})
    anchors = (
        a.where(~F.coalesce(F.array_contains("inside", F.col("head_token_id")), F.lit(False)))
        .groupBy(*S.SENTENCE, "entity_id")
        .agg(F.min_by("head_token_id", "token_id").alias("token_id"), F.min("first").getField("entity_name").alias("abbrev"))
    )
    heads = t.where(F.col("entity_type").isin(*keep) & (F.col("entity_name") != "")).select(*S.SENTENCE, "token_id", F.col("entity_name").alias("fullname"))
    return anchors.join(heads, [*S.SENTENCE, "token_id"]).select("file_id", "abbrev", "fullname").distinct()


def prune(t: DataFrame) -> DataFrame:
    """Without helpers, appositions, open complements and tokens without a role."""
    drop = (
        ((F.col("pos") == "AUX") & F.col("dep_rel").isin(*S.AUXILIARY)) | (F.col("role") == "appos") | ((F.col("pos") == "VERB") & (F.col("dep_rel") == "xcomp"))
    )
    return t.where(~drop)


def with_verb_flags(kept: DataFrame) -> DataFrame:
    """neg: the verb has a negation; has_sources: any token, entity or not, is its source."""
    verb = W.partitionBy(*VERB_KEY)
    return kept.withColumns(
        {
            "neg": F.bool_or(F.coalesce(F.col("dep_rel") == "neg", F.lit(False))).over(verb),
            "has_sources": F.bool_or(F.col("role") == "source").over(verb),
        }
    )


def adopt_sources(flagged: DataFrame, adoption: str = "equal") -> DataFrame:
    """Entities by role and verb; verbs without sources take those of their parent verb, one level
    up. ``adoption='substring'`` also takes those of verbs whose id begins with the parent's."""
    if adoption not in ("equal", "substring"):
        raise ValueError("adoption must be 'equal' or 'substring'")
    columns = [*S.SENTENCE, "verb_id", "parent_id", "role", "entity_id", "entity_type", "entity_name", "has_sources"]
    own = flagged.select(*columns).distinct()
    sources = own.where(F.col("has_sources") & (F.col("role") == "source"))
    unsourced = own.where(~F.col("has_sources")).select(*S.SENTENCE, F.col("verb_id").alias("child"), F.col("parent_id").alias("above")).distinct()
    s = sources.alias("s").join(unsourced.alias("u"), list(S.SENTENCE))
    match = F.col("verb_id") == F.col("above") if adoption == "equal" else F.col("verb_id").cast("string").startswith(F.col("above").cast("string"))
    adopted = s.where(match).select(*S.SENTENCE, F.col("child").alias("verb_id"), *columns[4:])
    return own.unionByName(adopted)


def verb_table(flagged: DataFrame, remove_neg: bool = True) -> DataFrame:
    v = flagged.where(F.col("pos").isin(*S.VERBS)).select(*VERB_KEY, "verb_name", "verb_lemma", "verb_tense", *LISTS, "neg")
    return v.where(~F.col("neg")) if remove_neg else v


def _any(a: str, words: Sequence[str]) -> F.Column:
    return F.coalesce(F.arrays_overlap(a, F.array(*map(F.lit, words))), F.lit(False))


def edge_flags(edges: DataFrame, going_on: str = "lemma") -> DataFrame:
    """has_hedge and is_future. ``going_on``: whether forms of "be" before "going" are looked for
    among the helpers' lemmas or their tokens."""
    hedge = (
        F.coalesce(F.col("head_verb_lemma").isin(*S.HEDGE_VERBS), F.lit(False))
        | _any("xcomp_verb", S.HEDGE_VERBS)
        | _any("helper_lemma", S.HEDGE_HELPERS)
        | _any("xcomp_helper_lemma", S.HEDGE_HELPERS)
    )
    going = F.col("xcomp_verb").isNotNull() & (F.col("head_verb_name") == "going") & _any(f"helper_{going_on}", S.BE_FORMS)
    future = _any("helper_lemma", S.FUTURE_HELPERS) | _any("xcomp_helper_lemma", S.FUTURE_HELPERS) | F.coalesce(going, F.lit(False))
    return edges.withColumns({"has_hedge": hedge, "is_future": future})


def edges_of(
    kept: DataFrame, keep: Sequence[str] = S.DEFAULT_TYPES, incomplete: bool = False, remove_neg: bool = True, adoption: str = "equal", going_on: str = "lemma"
) -> DataFrame:
    """(file_id, and the edge columns): every source of a verb with every target of it.

    Without ``incomplete`` both ends must be there; with it, verbs that have no complete edge keep
    their one-sided ones. A sentence's ends are one array: negations, adopted sources and pairs are found in it, as
    ``with_verb_flags``, ``adopt_sources`` and ``verb_table`` define them, and only edges become rows. Nothing is joined, and
    the one grouping is by the sentence that the tokens are already partitioned by.
    """
    if adoption not in ("equal", "substring"):
        raise ValueError("adoption must be 'equal' or 'substring'")
    end = F.struct(
        "verb_id", "parent_id", "role", F.coalesce(F.col("dep_rel") == "neg", F.lit(False)).alias("neg"), F.coalesce(F.col("role") == "source", F.lit(False)).alias("is_source"),
        F.when((F.col("entity_name") != "") & F.col("entity_type").isin(*keep), F.col("entity_name")).alias("name"),
    )
    verb = F.struct("verb_id", "verb_name", "verb_lemma", "verb_tense", *LISTS)
    rows = kept.where(F.col("verb_id").isNotNull()).groupBy(*S.SENTENCE).agg(
        F.collect_list(end).alias("ends"), F.collect_list(F.when(F.col("pos").isin(*S.VERBS), verb)).alias("verbs")
    )
    v = rows.select(*S.SENTENCE, "ends", F.explode("verbs").alias("v")).withColumn("own", F.filter("ends", lambda t: t.verb_id == F.col("v.verb_id")))
    v = v.withColumns(
        {
            "neg": F.exists("own", lambda t: t.neg),
            "unsourced": F.exists("own", lambda t: t.role.isNotNull()) & ~F.exists("own", lambda t: t.is_source),
            "above": F.filter(F.transform("own", lambda t: t.parent_id), lambda p: p.isNotNull()),
        }
    )
    if remove_neg:
        v = v.where(~F.col("neg"))

    def names(of: Column | str, role: str) -> Column:
        return F.transform(F.filter(of, lambda t: (t.role == role) & t["name"].isNotNull()), lambda t: t["name"])

    if adoption == "equal":
        near = F.filter("ends", lambda t: F.array_contains("above", t.verb_id))
    else:
        near = F.filter("ends", lambda t: F.exists("above", lambda p: F.startswith(t.verb_id.cast("string"), p.cast("string"))))
    v = v.withColumns(
        {"sources": F.array_distinct(F.when(F.col("unsourced"), names(near, "source")).otherwise(names("own", "source"))), "targets": F.array_distinct(names("own", "target"))}
    )
    if incomplete:
        none = F.array(F.lit(None).cast("string"))
        v = v.where((F.size("sources") > 0) | (F.size("targets") > 0)).withColumns({c: F.when(F.size(c) > 0, F.col(c)).otherwise(none) for c in ("sources", "targets")})
    pair = F.explode(F.flatten(F.transform("sources", lambda a: F.transform("targets", lambda b: F.struct(a.alias("source"), b.alias("target"))))))
    edges = v.select(*S.SENTENCE, "v", "neg", pair.alias("e")).select(
        "file_id",
        "e.source",
        "e.target",
        F.col("v.verb_name").alias("head_verb_name"),
        F.col("v.verb_lemma").alias("head_verb_lemma"),
        F.col("v.verb_tense").alias("head_verb_tense"),
        *[F.col(f"v.{c}").alias(c) for c in LISTS],
        "neg",
        (F.col("e.source").isNotNull() & F.col("e.target").isNotNull()).alias("edgeiscomplete"),
        F.concat_ws("_", "doc_id", "sentence_id", "v.verb_id").alias("doc_sent_verb"),
    )
    return edge_flags(edges, going_on).select("file_id", *EDGE_COLUMNS)


def nodes_of(kept: DataFrame, keep: Sequence[str] = S.DEFAULT_TYPES) -> DataFrame:
    """(file_id, entity_name, entity_type, num_appearances): mentions by entity and verb; the most
    frequent type, of equally frequent ones the first in the alphabet."""
    mentions = kept.where((F.col("entity_name") != "") & F.col("entity_type").isin(*keep)).select(*VERB_KEY, "entity_id", "entity_name", "entity_type").distinct()
    by_type = mentions.groupBy("file_id", "entity_name", "entity_type").agg(F.count("*").alias("n"))
    return by_type.groupBy("file_id", "entity_name").agg(
        F.min_by("entity_type", F.struct(-F.col("n"), "entity_type")).alias("entity_type"), F.sum("n").alias("num_appearances")
    )


def verbs_of(edges: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The edges' lemmas with the lexicon's classes. The lexicon is a reference list; the planner
    broadcasts it as long as its size is below the threshold."""
    return edges.select("head_verb_lemma").distinct().join(lexicon.select(F.col("verb").alias("head_verb_lemma"), "classes", "type_name", "type_id"), "head_verb_lemma", "left")


def extract_network(
    tokens: DataFrame,
    lexicon: DataFrame,
    keep: Sequence[str] = S.DEFAULT_TYPES,
    concatenator: str = "_",
    incomplete: bool = False,
    remove_neg: bool = True,
    adoption: str = "equal",
    going_on: str = "lemma",
) -> Extract:
    """The whole extraction. The consolidated tokens feed three branches and are written once to
    the shared folder."""
    if not keep:
        raise ValueError("at least one entity type must be kept")
    t = cut(entity_tokens(tokens, keep, concatenator))
    kept = prune(t)
    edges = edges_of(kept, keep, incomplete, remove_neg, adoption, going_on)
    return Extract(nodes_of(kept, keep), edges, verbs_of(edges, lexicon), appositives(t, keep))


def write_extract(e: Extract, path: str, overwrite: bool = True) -> None:
    """Four parquet folders under one path."""
    for name in ("nodes", "edges", "verbs", "appositives"):
        getattr(e, name).write.mode("overwrite" if overwrite else "ignore").parquet(f"{path}/{name}")


def read_extract(spark, path: str) -> Extract:
    return Extract(*[spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "verbs", "appositives")])
