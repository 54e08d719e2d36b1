"""Entity lists, their application to parsed tokens, and suggestions for new ones."""

from __future__ import annotations

import warnings
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import schemas as S
from tidegraph.session import hint_small

#: What the results to match take for true, for words that end names of bodies, and for labels by ending.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
ORG_SUFFIXES = (
    "Agency", "Department", "Bureau", "Commission", "Authority", "Administration", "Service", "Board", "Council", "Committee", "Corporation", "Company",
    "District", "Division", "Office", "Institute", "Association", "Foundation", "Organization", "Trust", "Fund", "Project", "Program", "Initiative",
)
LABEL_ENDINGS = (
    ("ORG", "agency department bureau commission authority administration service board council committee corporation company district division office institute association foundation organization trust fund"),
    ("LOC", "valley river lake mountain creek bay coast beach island county city state region park forest reserve"),
    ("FAC", "dam reservoir plant facility center station airport port bridge highway road trail"),
    ("LAW", "project program plan initiative act bill law agreement treaty"),
)
STANDARD = ("entity_names", "entity_label", "case_sensitive", "whole_word_only", "aliases")
SMALL_RULES = 200_000


def read_entity_file(spark: SparkSession, path: str) -> DataFrame:
    """A .csv file, or a .txt or .tsv file with tabs, with a header. Other endings are an error."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in ("csv", "txt", "tsv"):
        raise ValueError(f"unknown ending of {path}: .csv, .txt or .tsv")
    return spark.read.csv(path, header=True, sep="," if ending == "csv" else "\t")


def entity_specify(spec: DataFrame) -> DataFrame:
    """(pattern_id, label, text, tokens, case_sensitive): one row per name and alias.

    ``spec`` has the five standard columns, or those of a reviewed list (phrase, keep, ...), of which
    kept rows count, with final_label before suggested_label. Nameless rows are left out. A whole-word
    pattern has tokens and no text; any other has the text. Unless case-sensitive they're in lower case.
    """
    if {"phrase", "keep"} <= set(spec.columns):
        kept = spec.where(F.lower(F.trim(F.col("keep").cast("string"))).isin(*TRUE_WORDS))
        spec = kept.select(
            F.col("phrase").alias("entity_names"),
            F.coalesce(F.nullif(F.trim("final_label"), F.lit("")), F.col("suggested_label")).alias("entity_label"),
            F.lit(False).alias("case_sensitive"),
            F.lit(True).alias("whole_word_only"),
            F.lit("").alias("aliases"),
        )
    S.require(spec, STANDARD, "the entity list")

    def flag(c: str) -> Column:
        return F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))

    named = spec.where(F.trim("entity_names") != "").select(
        F.explode(F.concat(F.array("entity_names"), F.split(F.coalesce("aliases", F.lit("")), ";"))).alias("name"),
        F.col("entity_label").alias("label"),
        flag("case_sensitive").alias("case_sensitive"),
        flag("whole_word_only").alias("whole"),
    )
    name = F.trim("name")
    cased = F.when(F.col("case_sensitive"), name).otherwise(F.lower(name))
    return named.where(name != "").select(
        F.xxhash64("label", cased, "whole").alias("pattern_id"),
        "label",
        F.when(~F.col("whole"), cased).alias("text"),
        F.when(F.col("whole"), F.split(cased, r"\s+")).alias("tokens"),
        "case_sensitive",
    )


def specify_names(
    spark: SparkSession, names: Sequence[str], label: str | Sequence[str] = "CUSTOM", case_sensitive: bool = False, whole_word_only: bool = True, aliases: Sequence[str] | None = None
) -> DataFrame:
    """The same from plain lists; single values hold for all names."""
    n = len(names)
    labels = [label] * n if isinstance(label, str) else list(label)
    others = [""] * n if aliases is None else list(aliases)
    if len(labels) != n or len(others) != n:
        raise ValueError("labels and aliases must be one or as many as names")
    rows = [(a, b, case_sensitive, whole_word_only, c) for a, b, c in zip(names, labels, others, strict=True)]
    if not rows:
        warnings.warn("no entity names", stacklevel=2)
    return entity_specify(spark.createDataFrame(rows, "entity_names string, entity_label string, case_sensitive boolean, whole_word_only boolean, aliases string"))


def ruler_matches(tokens: DataFrame, patterns: DataFrame) -> DataFrame:
    """(sentence, start, n, label): where patterns occur. Whole-word patterns are equality of n-grams;
    patterns with text occur anywhere in the sentence, its tokens joined by blanks, and take all tokens they touch. Of
    overlapping matches the longest is taken, of equally long ones the first.

    Each token begins one n-gram per length that patterns have; the lengths are few. The patterns are
    broadcast while they're a bounded number, else joined by shuffle. Texts are looked for by one automaton for
    ``SMALL_RULES`` of them, further ones by further passes.
    """
    p = patterns.where(F.col("tokens").isNotNull()).select("label", F.col("tokens").alias("gram"), F.size("tokens").alias("n"), "case_sensitive").distinct()
    lengths = [r.n for r in p.select("n").distinct().collect()]
    rows = tokens.where(F.col("token_id").isNotNull()).groupBy(*S.SENTENCE).agg(F.array_sort(F.collect_set(F.struct("token_id", "token"))).alias("s"))
    found = [_gram_hits(rows, p, lengths)] if lengths else []
    texts = patterns.where(F.col("text") != "").select("text", "label", "case_sensitive").distinct().orderBy("text", "label").toLocalIterator()
    while chunk := list(islice(texts, SMALL_RULES)):
        found.append(_text_hits(rows, [tuple(r) for r in chunk]))
    if not found:
        return tokens.sparkSession.createDataFrame([], "file_id string, doc_id string, sentence_id int, start int, n int, label string")
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    hits = hits.groupBy(*S.SENTENCE, "start", "n").agg(F.min("label").alias("label"))
    # Longest first, then leftmost: a hit stays if it overlaps none that was taken before it.
    ordered = hits.groupBy(*S.SENTENCE).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "start", "n", "label"))).alias("h"))
    taken = F.aggregate(
        "h",
        F.slice("h", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: (x.start < y.start + y.n) & (y.start < x.start + x.n)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return ordered.select(*S.SENTENCE, F.explode(taken).alias("h")).select(*S.SENTENCE, "h.start", "h.n", "h.label")


def _text_hits(rows: DataFrame, texts: list[tuple[str, str, bool]]) -> DataFrame:
    """(sentence, start, n, label) of the texts within sentences; n counts up to the last token's number."""
    shared = rows.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {}
        for cased in (True, False):
            labels: dict[str, list[str]] = {}
            for text, label, c in shared.value:
                if c == cased:
                    labels.setdefault(text, []).append(label)
            if labels:
                automata[cased] = ahocorasick.Automaton()
                for text, names in labels.items():
                    automata[cased].add_word(text, (len(text), names))
                automata[cased].make_automaton()
        for b in batches:
            out = []
            for i, s in enumerate(b["s"].to_pylist()):
                for cased, automaton in automata.items():
                    ts = [(t["token"] or "") if cased else (t["token"] or "").lower() for t in s]
                    starts = [0, *accumulate(len(t) + 1 for t in ts)]
                    for last, (size, names) in automaton.iter(" ".join(ts)):
                        first, end = (s[bisect_right(starts, at) - 1]["token_id"] for at in (last - size + 1, last))
                        out += [(i, first, end - first + 1, name) for name in names]
            at, first, n, label = zip(*out, strict=True) if out else ((), (), (), ())
            kept = b.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(kept[c] for c in S.SENTENCE), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(label, pa.string())], names=[*S.SENTENCE, "start", "n", "label"])

    return rows.mapInArrow(run, "file_id string, doc_id string, sentence_id int, start int, n int, label string")


def _gram_hits(rows: DataFrame, p: DataFrame, lengths: list[int]) -> DataFrame:
    grams = rows.select(
        *S.SENTENCE,
        F.explode(
            F.flatten(
                F.transform(
                    "s",
                    lambda t, i: F.transform(
                        F.array(*map(F.lit, lengths)),
                        lambda n: F.struct(
                            t.token_id.alias("start"), (i + n <= F.size("s")).alias("fits"), n.alias("n"),
                            F.transform(F.slice("s", i + 1, n), lambda x: x.token).alias("gram"),
                        ),
                    ),
                )
            )
        ).alias("g"),
    ).where("g.fits").select(*S.SENTENCE, "g.start", "g.n", "g.gram")
    exact = grams.join(hint_small(p.where("case_sensitive"), SMALL_RULES), ["n", "gram"])
    lower = grams.withColumn("gram", F.transform("gram", F.lower)).join(hint_small(p.where(~F.col("case_sensitive")), SMALL_RULES), ["n", "gram"])
    return exact.unionByName(lower).select(*S.SENTENCE, "start", "n", "label")


def apply_ruler(tokens: DataFrame, patterns: DataFrame, overwrite_ents: bool = True) -> DataFrame:
    """Tokens with the tags of matched patterns. Without ``overwrite_ents`` a match that touches a
    tagged token is left out."""
    spans = ruler_matches(tokens, patterns).select(
        *S.SENTENCE, "start", "label", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("token_id")
    )
    t = tokens.join(spans, [*S.SENTENCE, "token_id"], "left")
    tag = F.concat("label", F.when(F.col("token_id") == F.col("start"), "_B").otherwise("_I"))
    if not overwrite_ents:
        from pyspark.sql import Window as W

        touched = F.max(F.coalesce("entity", F.lit("")) != "").over(W.partitionBy(*S.SENTENCE, "start"))
        tag = F.when(~touched, tag)
    return t.withColumn("entity", F.coalesce(F.when(F.col("start").isNotNull(), tag), F.col("entity"))).select(*tokens.columns)


def custom_entities(tokens: DataFrame, terms: dict[str, Sequence[str]], concatenator: str = "_") -> DataFrame:
    """Untagged tokens equal to a term, blanks as ``concatenator``, get LABEL_B; of several labels the
    first that is given."""
    order = [(t.replace(" ", concatenator), label, i) for i, (label, ts) in enumerate(terms.items()) for t in ts]
    first: dict[str, str] = {}
    for t, label, _ in order:
        first.setdefault(t, label)
    table = tokens.sparkSession.createDataFrame(list(first.items()), "token string, __label string")
    small = F.broadcast(table) if len(first) <= SMALL_RULES else table
    joined = tokens.join(small, "token", "left")
    untagged = F.coalesce("entity", F.lit("")) == ""
    return joined.withColumn("entity", F.when(untagged & F.col("__label").isNotNull(), F.concat("__label", F.lit("_B"))).otherwise(F.col("entity"))).select(*tokens.columns)


def filter_sentences(tokens: DataFrame, words: DataFrame, percent_threshold: float = 40, case_sensitive: bool = False) -> DataFrame:
    """The tokens of sentences of which at least that share of tokens is in the one-column word list.

    The list is a dictionary; the adaptive planner broadcasts it if it turns out small.
    """
    w = words.toDF("__w").where(F.col("__w").isNotNull())
    w = (w if case_sensitive else w.select(F.lower("__w").alias("__w"))).distinct().withColumn("__hit", F.lit(1))
    key = F.col("token") if case_sensitive else F.lower("token")
    hits = tokens.withColumn("__w", key).join(w, "__w", "left")
    share = hits.groupBy(*S.SENTENCE).agg(F.avg(F.coalesce("__hit", F.lit(0))).alias("share")).where(F.col("share") >= percent_threshold / 100)
    return tokens.join(share.select(*S.SENTENCE), list(S.SENTENCE), "left_semi")


def language_share(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(file_id, share): of each file's tokens with letters, those in the word list. Below a half,
    the file is hardly in the list's language."""
    w = words.toDF("__w").select(F.lower("__w").alias("__w")).distinct().withColumn("__hit", F.lit(1))
    t = tokens.where(F.col("token").rlike("[A-Za-z]")).select("file_id", F.lower("token").alias("__w"))
    return t.join(w, "__w", "left").groupBy("file_id").agg(F.avg(F.coalesce("__hit", F.lit(0))).alias("share"))


def suggest_single(tokens: DataFrame) -> DataFrame:
    """Untagged proper nouns of two letters or more with a leading capital, each once per occurrence."""
    c = (F.col("pos") == "PROPN") & (F.coalesce("entity", F.lit("")) == "") & (F.length("token") > 1) & F.col("token").rlike("^[A-Z]")
    return tokens.where(c).select(F.col("token").alias("phrase"), F.col("pos").alias("pos_tags"), *S.SENTENCE)


def _ordered(tokens: DataFrame) -> DataFrame:
    fields = F.struct("token_id", "token", "pos", F.coalesce("entity", F.lit("")).alias("entity"))
    return tokens.where(F.col("token_id").isNotNull()).groupBy(*S.SENTENCE).agg(F.array_sort(F.collect_set(fields)).alias("s"))


def suggest_multi(tokens: DataFrame) -> DataFrame:
    """Longest runs of two or more consecutive untagged proper nouns of a sentence (gaps and islands
    by token_id)."""
    from pyspark.sql import Window as W

    t = tokens.where((F.col("pos") == "PROPN") & (F.coalesce("entity", F.lit("")) == "") & F.col("token_id").isNotNull()).select(*S.SENTENCE, "token_id", "token", "pos").distinct()
    island = F.col("token_id") - F.row_number().over(W.partitionBy(*S.SENTENCE).orderBy("token_id"))
    runs = t.withColumn("island", island).groupBy(*S.SENTENCE, "island").agg(F.array_sort(F.collect_list(F.struct("token_id", "token", "pos"))).alias("r"))
    return runs.where(F.size("r") > 1).select(
        F.array_join(F.transform("r", lambda x: x.token), " ").alias("phrase"), F.array_join(F.transform("r", lambda x: x.pos), " ").alias("pos_tags"), *S.SENTENCE
    )


def suggest_org(tokens: DataFrame) -> DataFrame:
    """Names that end in a word such as Agency: back from it over capitalised tokens and of, the, and,
    for, without gaps; a leading "the" off; two tokens or more."""
    rows = _ordered(tokens)

    def back(i: Column) -> Column:
        """The place of the first token of the name that ends at place i (from 0)."""

        def step(acc: Column, _: Column) -> Column:
            here, before = F.get("s", acc.at), F.get("s", acc.at - 1)
            fits = before.token.rlike("^[A-Z]") | before.token.isin("of", "the", "and", "for")
            ok = F.coalesce((acc.at > 0) & (before.token_id == here.token_id - 1) & fits, F.lit(False))
            return F.when(acc.done, acc).otherwise(F.struct(F.when(ok, acc.at - 1).otherwise(acc.at).alias("at"), (~ok).alias("done")))

        return F.aggregate(F.sequence(F.lit(0), F.size("s")), F.struct(i.alias("at"), F.lit(False).alias("done")), step, lambda a: a.at)

    ends = rows.select(
        *S.SENTENCE,
        "s",
        F.explode(F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.get("s", i).token.isin(*ORG_SUFFIXES) & (F.get("s", i).entity == ""))).alias("i"),
    )
    found = ends.select(*S.SENTENCE, "s", "i", back(F.col("i")).alias("a"))
    first = F.get("s", F.col("a")).token
    found = found.withColumn("a", F.when((F.col("i") > F.col("a")) & (F.lower(first) == "the"), F.col("a") + 1).otherwise(F.col("a"))).where(F.col("i") > F.col("a"))
    return found.select(
        F.array_join(F.transform(F.slice("s", F.col("a") + 1, F.col("i") - F.col("a") + 1), lambda x: x.token), " ").alias("phrase"), F.lit("ORG_PATTERN").alias("pos_tags"), *S.SENTENCE
    )


def label_of(phrase: Column) -> Column:
    out = None
    for label, words in LABEL_ENDINGS:
        c = F.lower(phrase).rlike("(" + "|".join(words.split()) + ")$")
        out = F.when(c, label) if out is None else out.when(c, label)
    return out.otherwise("ORG")


def suggest_entities(tokens: DataFrame, min_frequency: int = 2, max_suggestions: int = 100, include_context: bool = True, context_examples: int = 3) -> DataFrame:
    """(phrase, frequency, pos_tags, suggested_label, context_examples, keep, final_label): the most
    frequent candidates, for review. Ties go by phrase; contexts are the first sentences that hold the
    phrase's first token.

    Frequencies are counted over all tokens; only the top list, whose length is a parameter, meets
    the sentences again.
    """
    S.require(tokens, S.TOKEN_COLUMNS, "tokens")
    clean = tokens.select(*S.TOKEN_COLUMNS).distinct()
    found = suggest_single(clean).unionByName(suggest_multi(clean)).unionByName(suggest_org(clean))
    by_pos = found.groupBy("phrase", "pos_tags").agg(F.count("*").alias("n"))
    top = (
        by_pos.groupBy("phrase")
        .agg(F.sum("n").alias("frequency"), F.min_by("pos_tags", F.struct(-F.col("n"), "pos_tags")).alias("pos_tags"))
        .where(F.col("frequency") >= min_frequency)
        .orderBy(F.desc("frequency"), "phrase")
        .limit(max_suggestions)
    )
    out = top.withColumn("suggested_label", label_of(F.col("phrase")))
    if include_context:
        firsts = top.select("phrase", F.get(F.split("phrase", " "), F.lit(0)).alias("token"))
        places = clean.select("token", F.struct(*S.SENTENCE).alias("at")).join(F.broadcast(firsts), "token").select("phrase", "at").distinct()
        # Only the first few per phrase are kept by each map task's partial aggregate.
        from pyspark.sql import Window as W

        ranked = places.withColumn("r", F.row_number().over(W.partitionBy("phrase").orderBy("at"))).where(F.col("r") <= context_examples)
        lines = clean.join(F.broadcast(ranked.select("at.*").distinct()), list(S.SENTENCE)).groupBy(*S.SENTENCE).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_id", "token"))), lambda x: x.token), " ").alias("line")
        )
        context = ranked.select("phrase", "r", "at.*").join(lines, list(S.SENTENCE)).groupBy("phrase").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x.line), " | ").alias("context_examples")
        )
        out = out.join(context, "phrase", "left")
    else:
        out = out.withColumn("context_examples", F.lit(""))
    return out.select("phrase", "frequency", "pos_tags", "suggested_label", "context_examples", F.lit("").alias("keep"), F.lit("").alias("final_label"))


def write_suggestions(suggestions: DataFrame, path: str) -> None:
    """One CSV file with a header, for review: the list is short by construction."""
    suggestions.coalesce(1).write.mode("overwrite").csv(path, header=True)
