"""Pages to parsed tokens, with a pluggable annotator."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegraph import schemas as S
from tidegraph.operators.entities import apply_ruler, custom_entities
from tidegraph.session import cut

SCHEMA = (
    "file_id string, doc_id string, sentence_id int, token_id int, token string, lemma string, pos string, tag string, "
    "head_token_id int, dep_rel string, entity string"
)
#: Tokens from which an annotating task passes on what it has, and pages that it takes out of a batch at once.
TOKENS, PAGES = 10_000, 200


class Annotator(Protocol):
    """Gives the sentences of a text: lists of (token, lemma, pos, tag, head, dep_rel, entity)."""

    def __call__(self, text: str) -> Iterable[list[tuple]]: ...


def concatenate_phrases(c: Column, phrases: Sequence[str], concatenator: str = "_") -> Column:
    """Phrases with blanks, read as expressions, in the order given, with their blanks as concatenators."""
    for p in phrases:
        if re.search(r"\s", p):
            c = F.regexp_replace(c, p, re.sub(r"([\\$])", r"\\\1", re.sub(r"\s", concatenator, p)))
    return c


def keep_hyphens(c: Column, concatenator: str = "_") -> Column:
    """Hyphens and dashes inside of words as concatenators, so that parsers leave the word whole."""
    return F.regexp_replace(c, r"(?<=\w)[\-–](?=\w)", concatenator)


class RuleAnnotator:
    """A small deterministic annotator for tests and demonstrations: words by pattern, verbs by list and
    ending, the nearest noun before a verb as its subject and after it as its object."""

    AUX = frozenset("will shall may might can could must should would is are was were be been has have had do does did".split())
    SMALL = {"the": "DET", "a": "DET", "an": "DET", "any": "DET", "of": "ADP", "in": "ADP", "to": "PART", "and": "CCONJ", "or": "CCONJ", "by": "ADP", "for": "ADP", "with": "ADP", "on": "ADP", "at": "ADP"}

    def __init__(self, verbs: Iterable[str] = ()) -> None:
        self.verbs = {form: v for v in verbs for form in (v, v + "s", v + "es", v + "ed", v + "d", v.rstrip("e") + "ing")}

    def __call__(self, text: str) -> Iterator[list[tuple]]:
        for sentence in re.split(r"(?<=[.!?])\s+|\n\s*\n", text):
            words = re.findall(r"\w+(?:[-']\w+)*|[^\w\s]", sentence)
            if words:
                yield self._parse(words)

    def _parse(self, words: list[str]) -> list[tuple]:
        pos, lows = [], [w.lower() for w in words]
        for w, low in zip(words, lows, strict=True):
            pos.append(
                "AUX" if low in self.AUX else self.SMALL[low] if low in self.SMALL else "PUNCT" if not w[0].isalnum() and w[0] != "_" else "NUM" if w.isdigit()
                else "VERB" if low in self.verbs else "PROPN" if w[0].isupper() else "NOUN"
            )
        root = next((i for i, p in enumerate(pos) if p == "VERB"), next((i for i, p in enumerate(pos) if p == "AUX"), next((i for i, p in enumerate(pos) if p in ("NOUN", "PROPN")), 0)))
        verbs = [j for j, q in enumerate(pos) if q == "VERB"] or [root]

        def nearest(i: int) -> int:
            j = bisect_left(verbs, i)
            return verbs[j - 1] if j and (j == len(verbs) or i - verbs[j - 1] <= verbs[j] - i) else verbs[j]

        out = []
        for i, (w, low, p) in enumerate(zip(words, lows, pos, strict=True)):
            if i == root:
                head, dep = i, "ROOT"
            elif p == "AUX":
                head, dep = nearest(i), "aux"
            elif p in ("NOUN", "PROPN") and i + 1 < len(words) and pos[i + 1] == p:
                head, dep = i + 1, "compound"
            elif p in ("NOUN", "PROPN"):
                v = nearest(i)
                head, dep = v, "nsubj" if i < v else "dobj"
            elif p == "VERB":
                head, dep = root, "conj"
            else:
                head, dep = (i + 1, "det") if p == "DET" and i + 1 < len(words) else (root, "punct" if p == "PUNCT" else "dep")
            tag = {"PROPN": "NNP", "NOUN": "NN", "VERB": "VBZ", "AUX": "MD"}.get(p, p)
            entity = "" if p != "PROPN" else "ORG_I" if i and pos[i - 1] == "PROPN" else "ORG_B"
            out.append((w, self.verbs.get(low, w if p == "PROPN" else low), p, tag, head + 1, dep, entity))
        return out


def parse_text(
    pages: DataFrame,
    annotator: Annotator | Callable[[], Annotator],
    keep_hyph_together: bool = False,
    phrases: Sequence[str] = (),
    concatenator: str = "_",
    patterns: DataFrame | None = None,
    ruler_position: str = "after",
    overwrite_ents: bool = True,
    custom: dict[str, Sequence[str]] | None = None,
    make: bool = False,
) -> DataFrame:
    """Tokens of (file_id, page_no, text). doc_id is ``text`` and the page's number.

    The annotator is sent to the tasks; with ``make`` it is a function that builds one per task, for
    those with models. Null pages have no tokens. Pages are independent, so nothing is shuffled until
    patterns are applied; tokens leave the annotator by ``TOKENS``, however many pages a batch has. file_id must not be null. Patterns come ``after`` the annotator's entities, and override them
    with ``overwrite_ents``, or ``before`` them: then the annotator has the last word.
    """
    if ruler_position not in ("after", "before"):
        raise ValueError("ruler_position must be 'after' or 'before'")
    S.require(pages, ("file_id", "page_no", "text"), "pages")
    text = concatenate_phrases(F.col("text"), phrases, concatenator)
    if keep_hyph_together:
        text = keep_hyphens(text, concatenator)

    types = T._parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(types)

    def columns(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type, from_pandas=True) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annotate = annotator() if make else annotator
        rows: list[tuple] = []
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                for f, n, t in zip(*(c.to_pylist() for c in b.slice(at, PAGES).columns), strict=True):
                    for s, sentence in enumerate(annotate(t) if t is not None else (), 1):
                        rows += [(f, f"text{n}", s, i, w, lemma, p, tag, h, d, e) for i, (w, lemma, p, tag, h, d, e) in enumerate(sentence, 1)]
                        if len(rows) >= TOKENS:
                            yield columns(rows)
                            rows = []
        if rows:
            yield columns(rows)

    tokens = pages.select("file_id", "page_no", text.alias("text")).where(F.col("file_id").isNotNull()).mapInArrow(run, types)
    if patterns is not None:
        tokens = apply_ruler(tokens, patterns, overwrite_ents and ruler_position == "after")
    if custom:
        tokens = custom_entities(tokens, custom, concatenator)
    return tokens


def should_parse(exists: bool, overwrite: bool, test: bool) -> tuple[bool, bool]:
    """(parse, save) of a document: parsed if it must be written or in test mode; saved unless kept."""
    return overwrite or not exists or test, overwrite or not exists


def parse_files(pages: DataFrame, annotator: Annotator | Callable[[], Annotator], path: str, overwrite: bool = True, test: bool = False, **options) -> DataFrame:
    """``parse_text`` with its results kept in one folder per file under ``path``. Without ``overwrite`` files that are
    there are neither parsed nor written again, with ``test`` parsed but not written. Returns what was parsed."""
    parse_all, _ = should_parse(True, overwrite, test)
    there = _saved(pages.sparkSession, path)
    todo = pages if parse_all or there is None else pages.join(there, "file_id", "left_anti")
    tokens = cut(parse_text(todo, annotator, **options))
    save_tokens(tokens, path, overwrite)
    return tokens


def _saved(spark: SparkSession, path: str) -> DataFrame | None:
    """The file_ids under the folder, or None if there is no such folder; any other failure is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(SCHEMA).parquet(path).select("file_id").distinct()


def save_tokens(tokens: DataFrame, path: str, overwrite: bool = True) -> None:
    """One folder per file. Without ``overwrite`` existing files stay and only new ones are added."""
    if overwrite:
        tokens.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path)
        return
    there = _saved(tokens.sparkSession, path)
    new = tokens if there is None else tokens.join(there, "file_id", "left_anti")
    new.write.mode("append").partitionBy("file_id").parquet(path)
