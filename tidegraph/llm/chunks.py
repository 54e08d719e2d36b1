"""Cutting long texts into overlapping pieces at natural boundaries, by pointer doubling.

Every place where a piece may start is a node: a cut's end less the overlap. Each node is joined to
its farthest legal successor, for all nodes of a block of texts at once (a sorted-array join: binary
search). The successor tables are then squared, 1, 2, 4, ... cuts ahead, and the set of nodes
reachable from each text's start doubles with each table, so that all greedy cuts come out in a
number of array steps that is the logarithm of the longest text's number of pieces. No loop goes
from cut to cut.

Texts are rows and stay whole; a task holds one Arrow batch of them. Hot keys don't exist here: no
row needs another, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.session import table

LIMIT, OVERLAP = 2000, 200
#: A paragraph or sentence end is only taken if the piece is then at least this part of the limit.
LEAST = 0.5
#: Arrow rows are taken together up to so many characters.
BLOCK_CHARS = 1 << 20

_PARAGRAPH = re.compile(r"\n[^\S\n]*\r?\n\s*")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s+|(?<=[。！？])|$)")
_WORD = re.compile(r"\s+")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places after each paragraph, sentence and word, ascending; white space ends the piece."""
    return tuple(np.array([m.end() for m in p.finditer(text)], np.int64) for p in (_PARAGRAPH, _SENTENCE, _WORD))


def _farthest(ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest of ``ends`` in (low, high], or -1."""
    if not len(ends):
        return np.full(len(low), -1)
    at = np.searchsorted(ends, high, side="right") - 1
    got = np.where(at >= 0, ends[np.maximum(at, 0)], -1)
    return np.where(got > low, got, -1)


def cuts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end) of every piece, in order. A text of up to ``limit`` characters is
    one piece, an empty one none."""
    # All texts on one axis, with a gap so that nothing reaches over.
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.r_[0, np.cumsum(lengths + 1)][:-1]
    last = base + lengths
    kinds = [np.concatenate([b + x for b, x in zip(base, per, strict=True)]) if texts else np.zeros(0, np.int64) for per in zip(*map(boundaries, texts), strict=True)] or [np.zeros(0, np.int64)] * 3
    # Nodes: the start of each text, each natural end and each hard cut that can follow from one.
    # Through a stretch without boundaries, hard cuts follow at one distance, so a whole run of them
    # is added at once; the loop ends after the few rounds that new nodes turn up in.
    ends = np.unique(np.concatenate([*kinds, base, last]))
    owner = np.searchsorted(base, ends, side="right") - 1

    def follow(start: np.ndarray, done: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The end of the piece that starts at ``start``, when all before ``done`` is covered."""
        high = np.minimum(start + limit, last[of])
        best = np.where(start + limit >= last[of], last[of], -1)
        for k, e in enumerate(kinds):
            low = np.maximum(done, start + int(limit * least)) if k < 2 else done
            best = np.where(best < 0, _farthest(e, low, high), best)
        return np.where(best < 0, high, best)

    def start_of(end: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(end == base[of], end, np.maximum(end - overlap, base[of]))

    fresh, fresh_owner, nodes, owners, succ = ends, owner, [], [], []
    while len(fresh):
        to = follow(start_of(fresh, fresh_owner), fresh, fresh_owner)
        nodes.append(fresh)
        owners.append(fresh_owner)
        succ.append(to)
        known = np.sort(np.concatenate(nodes))
        at = np.minimum(np.searchsorted(known, to), len(known) - 1)
        new, first = np.unique(to[known[at] != to], return_index=True)
        new_owner = fresh_owner[known[at] != to][first]
        stop = ends[np.minimum(np.searchsorted(ends, new, side="right"), len(ends) - 1)]
        runs = np.maximum(1, -(-(stop - new) // (limit - overlap)))
        within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        fresh, first = np.unique(np.repeat(new, runs) + within * (limit - overlap), return_index=True)
        fresh_owner = np.repeat(new_owner, runs)[first]
        unknown = known[np.minimum(np.searchsorted(known, fresh), len(known) - 1)] != fresh
        fresh, fresh_owner = fresh[unknown], fresh_owner[unknown]
    node, of, to = np.concatenate(nodes or [ends]), np.concatenate(owners or [owner]), np.concatenate(succ or [ends])
    order = np.argsort(node)
    node, of, to = node[order], of[order], to[order]
    jump = np.searchsorted(node, to)  # a text's last node leads to itself
    # Doubling: with the table of 2^k cuts, the reached set grows from 2^k to 2^(k+1) cuts.
    reached = np.zeros(len(node), bool)
    reached[np.searchsorted(node, base[lengths > 0])] = True
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        further = jump[jump]
        if np.array_equal(more, reached) and np.array_equal(further, jump):
            break
        reached, jump = more, further
    at = np.flatnonzero(reached & (node < last[of]))
    return of[at], start_of(node[at], of[at]) - base[of[at]], to[at] - base[of[at]]


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(``key``, piece_no from 1, start, end, piece): code points [start, end) of the text.

    A piece has at most ``limit`` characters and ends after a paragraph or sentence if that leaves
    it at least half full, else after a word if any ends in reach, else at the limit. Each piece but
    the first begins ``overlap`` characters before the end of the one before. Texts within the limit
    give one piece; null and empty texts none. Every row of ``df`` is cut, repeats too; keys may be
    null. Extra columns are dropped.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__text") != "")

    def block(keys: list, texts: list[str]) -> pa.RecordBatch:
        of, start, end = cuts(texts, limit, overlap)
        first = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
        number = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0)) + 1
        out = [keys.take(pa.array(of)), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
        if with_text:
            out.append(pa.array([texts[i][a:b] for i, a, b in zip(of, start, end, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(out, names=[key, "piece_no", "start", "end"] + ["piece"] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at, size = b["__text"].to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK_CHARS or i + 1 == len(texts):
                    yield block(b["__key"].slice(at, i + 1 - at), texts[at : i + 1])
                    at, size = i + 1, 0

    kind = dict(rows.dtypes)["__key"]
    return rows.mapInArrow(run, f"`{key}` {kind}, piece_no int, start int, end int" + ", piece string" * with_text)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A redelivered page counts once."""
    return table(spark, sf_dir, "text_list").select("page_key", "text_list").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that come out in more than one piece."""
    cut = pieces(table(spark, sf_dir, "text_list"), "page_key", "text_list", with_text=False)
    return cut.where(F.col("piece_no") == 2).select("page_key").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all pages."""
    return pieces(_pages(spark, sf_dir), "page_key", "text_list")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
ORACLE = {"p2_found": "select distinct page_key from text_list where length(text_list) > 2000"}
