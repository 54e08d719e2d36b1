"""Repairing text from scanned pages.

The corpus itself says what is noise; nothing is listed but the shapes that scanners confuse.

1. Running heads: the first and last lines of a page, without numbers, that recur on a share of
   the file's pages or, with the file's own name masked, in several files; and lines within a few
   errors of one of them. Page numbers: edge lines that hold the page's own number.
2. Vocabulary: every word's count, apart for files with and without traces of scanning. Words
   are grouped by their strokes (``rn``, ``m`` and ``in`` are three strokes each), so that all
   confusions of a word meet in one group and no candidates need to be listed.
   A rare form is a misreading if its group has a far more frequent one and files that weren't
   scanned don't bear it out.
   Words, and pairs of neighbours that matter, are counted by the written token of a batch of pages.
3. Each page, with lines and heads taken away, is one stream of words. A lattice of its
   segments (as it stands, with the confusion undone, up to three merged over stray blanks, line ends
   and hyphens, one split where two words ran together, merges and splits with the confusion undone
   too) is decoded by least cost; paragraph boundaries are chosen by dynamic
   programming over the lines. What a page needs of the vocabulary reaches it by joins on the
   words it holds, so the vocabulary may be of any size. Sieves of fixed size (`Sieve`) keep what can't
   matter out of the joins, and only lines near something that may be wrong are looked at closely.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce
from itertools import accumulate, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import cut, hint_small, scratch, table

#: Lines at either end of a page that can be heads; least pages and share of a file's pages, and least files, of a head.
EDGE, HEAD_PAGES, HEAD_SHARE, HEAD_FILES = 3, 2, 0.02, 3
#: A misreading is at most this part as frequent as what it stands for, which occurs so often.
RARE_SHARE, LEAST_COUNT = 0.12, 3
#: In files without traces of scanning, a form this frequent, against scanned ones, is no misreading.
CLEAN_SHARE = 0.1
#: Costs of a damage in the lattice, against the logarithm of how much more frequent the repaired form is.
CONFUSED, STRAY, RUN_ON, HYPHEN = 1.0, 1.0, 1.0, 1.0
#: Most segments that are merged; least letters of a merged word and of one that is split; most letters of either.
MERGED, LEAST_LETTERS, MOST_LETTERS = 3, 5, 30
#: Cost of a paragraph of one line that is a fragment.
LONE = 1.5
SMALL_ROWS = 300_000
#: Rows delivered again up to which their hashes are broadcast; distinct tokens or pairs of tokens a task counts before it passes them on.
REPEATED_ROWS, COUNTED = 1_000_000, 200_000
#: Bits of a sieve: at least, at most, and for each word of the corpus.
LEAST_BITS, MOST_BITS, WORD_BITS = 1 << 12, 1 << 26, 16

#: Letters and signs as strokes. What scanners confuse has the same strokes.
STROKES = {
    "m": "iii", "n": "ii", "u": "ii", "h": "ii", "b": "ii", "r": "i", "i": "i", "l": "i", "j": "i", "1": "i", "|": "i", "!": "i",
    "d": "ci", "c": "c", "e": "c", "¢": "c", "o": "o", "0": "o", "t": "t", "†": "t", "f": "t", "ſ": "t", "w": "vv", "v": "v",
    "5": "s", "$": "s", "s": "s", "9": "g", "q": "g", "g": "g", "8": "ii", "6": "ii",
}
#: Digits and the letters misread for them.
DIGITS = {"l": "1", "I": "1", "|": "1", "i": "1", "O": "0", "o": "0", "S": "5", "s": "5", "Z": "2", "B": "8", "g": "9", "q": "9", "b": "6"}
#: Signs that end a line in a broken word.
HYPHENS = "-‐‑–¬=­~"
ODD_HYPHENS = "‐‑–¬=­~"
_STRAY = set("~^`´'’.*_:°·")
_MATH = re.compile("[\U0001d400-\U0001d7ff]")
_TRACE = re.compile(r"[^\W\d_][¢†ſ|^`~]|[¢†ſ|^`~][^\W\d_]|[^\W\d_][‐‑¬=­][ \t]*$", re.M)
_NUMBER = re.compile(r"[$€£]?(?:\d{1,3}(?:,\d{3})+|[1-9]\d*|0)(?:\.\d+)?%?")
#: Signs that may stand around a word.
_AROUND = "\"'([{“‘«¿¡)]}”’»,;:!?."
_LETTERS = re.compile(r"[^\W\d_¢†|^`~]+(?:[¢†|^`~][^\W\d_]*)*")
_DASHES = re.compile(r"[-/—–]")
_WORDS, _PARTS = re.compile(r"\S+"), re.compile(r"[^-/—–]+")
#: Without one of these signs there is no trace; without the pattern no line is broken.
_TRACES = "¢†ſ|^`~‐‑¬=\xad"
_CUT = re.compile(r"[-‐‑–¬=\xad~]\s*(?:\n|\Z)")
_WIDE = re.compile(r"[^\S\n]{3,}")
_FIRST_NUMBER, _ODD_START = re.compile(r"[\W_]*(?:(?:page|p\.?|[-–])\s*)?\b(\d+)\b[\W_]+(?=[^\W\d_])"), re.compile(r"[^\w©(\[]+")
_SECTION, _LETTER_RUN, _DIGIT_RUN, _GAP = re.compile(r"\d+\.\d+ "), re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"\s{3,}")
_BEFORE_NUMBER = re.compile(r"[\W_]*(?:(?:page|p\.?|[-–])\s*)?$")
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)


@lru_cache(maxsize=1 << 17)
def strokes(w: str) -> str:
    w = unicodedata.normalize("NFD", w.lower())
    return "".join(STROKES.get(c, c) for c in w if c not in _STRAY and not unicodedata.combining(c))


def split_words(line: str) -> list[str]:
    """The words of a line, compounds apart; without words of mathematical letters."""
    out = []
    for w in line.split():
        for p in _DASHES.split(w) if not w.isalpha() else (w,):
            p = p.strip(_AROUND)
            if p and len(p) <= 30 and (p.isalnum() or any(c.isalnum() for c in p)) and (p.isascii() or not _MATH.search(p)):
                out.append(p)
    return out


def compounds(line: str) -> list[str]:
    out = []
    for w in line.split():
        if "-" in w:
            ps = [p.strip(_AROUND).lower() for p in w.split("-")]
            out += [f"{a}-{b}" for a, b in zip(ps, ps[1:], strict=False) if a and b]
    return out


def roman(s: str) -> int:
    v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n = [v[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0], strict=True))


def as_digits(s: str) -> str:
    return "".join(DIGITS.get(c, c) for c in s)


def is_page_number(line: str, page_no: int) -> bool:
    """Whether the line holds the page's number, in any style, and nothing else."""
    s = line.strip()
    if len(s) > 40 or not s:
        return False
    s = re.sub(r"(?<!\S)p ?a ?g ?e(?!\S)", "page", s, flags=re.I)
    if m := re.fullmatch(r"(\w{1,6})\W+(page|p|pg)\W*", s, re.I):  # the number first
        s = f"{m[2]} {m[1]}"
    s = re.sub(r"^[\W_]+|[\W_]+$", "", s.replace("|", "l")).strip()
    if not s or len(s) > 24:
        return False
    m = re.fullmatch(r"(?:(?:page|pag|pg|p|seite|s|pagina|página|folio|f)\b[\W_]*)?(?:[A-Z]{1,3}\s?[-–.]\s?)?(\w+)(?:\s*(?:of|de|von|/)\s*\w+)?", s, re.I)
    if not m:
        return False
    n = m.group(1)
    if re.search(r"\d", n) and (d := as_digits(n)).isdigit() and int(d) == page_no:
        return True
    if not re.search(r"\d", n) and len(n) <= 3 and (d := as_digits(n)).isdigit() and int(d) == page_no and page_no > 9 and len(s) > len(n):
        return True
    return bool(_ROMAN.fullmatch(n)) and roman(n) == page_no


def head_forms(line: str, page_no: int) -> list[tuple[str, bool, bool]]:
    """A line as it may recur, each form with whether it can be a head by itself, and whether it is a
    title: whole, and both parts if one wide gap divides it. The page's number is taken off."""
    line = line.strip()
    if len(line) > 240:  # no head is as long, wide gaps included
        return []
    parts = [p for p in _GAP.split(line) if p]
    parts = [p for p in parts if len(parts) == 1 or not is_page_number(p, page_no)]
    found: dict[str, tuple[bool, bool]] = {}
    for i, part in enumerate([line, *(parts if len(parts) == 2 else ())]):
        if (got := _head_form(part, page_no)) is not None:
            form, strict, title = got
            found.setdefault(form, (strict, title and i == 0 and len(parts) == 1))
    return [(f, *x) for f, x in found.items()]


def _head_form(line: str, page_no: int) -> tuple[str, bool, bool] | None:
    s = " ".join(line.split())
    number = str(page_no)
    m = _FIRST_NUMBER.match(s)
    if not m or m[1] != number:
        m = _ODD_START.match(s)
    s = s[m.end() :] if m else s
    end = len(s)
    while end and not s[end - 1].isalnum():
        end -= 1
    start = end - len(number)
    if s[:end].endswith(number) and s[end : end + 1] != "_" and not (start and (s[start - 1].isalnum() or s[start - 1] == "_")):
        s = s[: _BEFORE_NUMBER.search(s, 0, start).start()]
    s = s.strip(" -–|:·•~")
    if len(s) < 5 or len(s) > 120 or _SECTION.match(s) or sum(map(str.isalpha, s)) < 5:
        return None
    words = _LETTER_RUN.findall(s)
    capitals = sum(w[0].isupper() for w in words) / len(words)
    # What ends or begins like prose is no head by itself, but may be a damaged one.
    prose = s[-1] in ".;,!?\"" or s[0].islower()
    if prose and capitals < 0.5:
        return None
    return s.lower(), not prose, not prose and capitals >= 0.6


def mask(form: str, file_id: str) -> str:
    """The form with the words of the file's name masked, and numbers too."""
    own = _name_words(file_id)
    return _DIGIT_RUN.sub("#", _LETTER_RUN.sub(lambda m: "@" if m[0] in own else m[0], form))


@lru_cache(maxsize=1 << 10)
def _name_words(file_id: str) -> frozenset[str]:
    return frozenset(w for w in re.split(r"[\W_]+", file_id.lower()) if len(w) > 2)


def close(a: Column, b: Column) -> Column:
    """Whether two heads differ by few errors, blanks left out."""
    a, b = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    most = F.greatest(F.lit(1), F.least(F.length(a), F.length(b)) / 7)
    return F.levenshtein(a, b) <= most


def content_lines(lines: list[str], skip: set[int]) -> list[int]:
    """The places of the lines that hold the page's own text."""
    return [i for i, line in enumerate(lines) if line.strip() and i + 1 not in skip]


def broken(line: str) -> tuple[str, str] | None:
    """(what stands before the hyphen at the end, the hyphen) of a line that ends in one."""
    s = line.rstrip(" \t\r")
    if len(s) < 2 or s[-1] not in HYPHENS or not s[-2].isalpha():
        return None
    word = re.split(r"[\s\-/—]", s[-64:-1])[-1]
    return word.lstrip("\"'([{“‘«"), s[-1]


def first_word(line: str) -> str:
    ws = line.split()
    return re.split(r"[-/—–]", ws[0].strip(_AROUND))[0] if ws else ""


def countable(lines: list[str], at: list[int], lead: bool = False) -> Iterator[tuple[str, bool]]:
    """(word or compound, is compound) of a page, without what hyphens cut at line ends. lead: the page before ends in one."""
    after_break = lead
    for n, i in enumerate(at):
        ws = split_words(lines[i])
        cut_end = broken(lines[i]) is not None
        ws = ws[1 if after_break and ws else 0 : len(ws) - 1 if cut_end else len(ws)]
        for w in ws:
            yield w.lower(), False
        for c in compounds(lines[i]):
            yield c, True
        after_break = broken(lines[i]) is not None


class Piece(NamedTuple):
    """A word of the page's stream: its line and place there, and what parts it from the one before:
    "b" a blank, "l" a line end, "h" a hyphen at a line end, else "" (a sign, a wide gap, a blank line)."""

    line: int
    start: int
    end: int
    core: str
    gap: str


@lru_cache(maxsize=1 << 16)
def token_parts(word: str) -> tuple[tuple[tuple[int, str], ...], bool]:
    """(place, core) of a written token's words, the core empty for what is none; whether nothing follows the last one."""
    if word.isalpha():  # most words: nothing around them, and nothing to divide
        ok = len(word) <= MOST_LETTERS and (word.isascii() or not _MATH.search(word))
        return ((0, word if ok else ""),), ok
    out, is_open = [], False
    for q in _PARTS.finditer(word):
        core = q[0].strip(_AROUND)
        ok = bool(core) and len(core) <= MOST_LETTERS and any(map(str.isalnum, core)) and (core.isascii() or not _MATH.search(core))
        start = q.start() + q[0].index(core) if ok else 0
        out.append((start, core if ok else ""))
        is_open = ok and start + len(core) == len(word)
    return tuple(out), is_open


def pieces(lines: list[str], at: list[int]) -> list[Piece]:
    """The words of a page as one stream, those of ``split_words``."""
    out: list[Piece] = []
    gap_open = False
    for n, i in enumerate(at):
        gap = "" if not n else "h" if broken(lines[at[n - 1]]) else "l" if at[n - 1] == i - 1 and out and gap_open else ""
        line = lines[i].rstrip()
        line = line[:-1] if broken(line) else line
        gap_open, last = False, None
        for m in _WORDS.finditer(line):
            word, begin, end = m[0], m.start(), m.end()
            if last is not None:
                gap = "b" if gap_open and begin - last <= 2 else ""
            parts, is_open = token_parts(word)
            for start, core in parts:
                if core:
                    out.append(Piece(i, begin + start, begin + start + len(core), core, gap if gap == "h" or not start else ""))
                gap = ""
            if parts:
                gap_open = is_open
            last = end
    return out


@lru_cache(maxsize=1 << 16)
def _is_letters(w: str) -> bool:
    return _LETTERS.fullmatch(w) is not None


def near(at: list[int], hot: set[int]) -> list[list[int]]:
    """The hot ones of the lines ``at`` with one neighbour on either side, as unbroken stretches."""
    out: list[list[int]] = []
    end = 0
    for n, i in enumerate(at):
        if i in hot:
            start = max(n - 1, 0)
            if out and start <= end:
                out[-1] += at[end : n + 2]
            else:
                out.append(at[start : n + 2])
            end = min(n + 2, len(at))
    return out


def mergeable(ps: list[Piece]) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of segments that may be one word: of letters, and of two lines at most."""
    letters = [_is_letters(p.core) for p in ps]
    for i in range(len(ps)):
        if not letters[i]:
            continue
        size, line = len(ps[i].core), ps[i].line
        for j in range(i + 1, min(len(ps), i + MERGED)):
            p = ps[j]
            size += len(p.core)
            if not p.gap or not letters[j] or size > MOST_LETTERS or p.line != line and (ps[j - 1].line not in (line, p.line) or len({q.line for q in ps[i : j + 1]}) > 2):
                break
            # A single hyphen between two halves is decided by join().
            if size >= LEAST_LETTERS and not (j == i + 1 and p.gap == "h"):
                yield i, j + 1


def merged_key(ps: list[Piece]) -> str:
    return " ".join(p.core.lower() for p in ps)


def is_half(ps: list[Piece], i: int, lead: bool) -> bool:
    """Whether a hyphen at a line's or page's end cuts the segment off its word."""
    return ps[i].gap == "h" or (i + 1 < len(ps) and ps[i + 1].gap == "h") or (i == 0 and lead)


def segments(ps: list[Piece], facts: dict[str, tuple[int, str | None]], gains: dict[str, float], lead: bool, joins: dict[int, str | None]) -> list[tuple[int, int, str | None]]:
    """The page's lattice decoded: (first, end, what it should be or None as it stands) of the arcs of
    least cost. joins: places of the halves that ``join`` puts to the half before, with the word if it is misread."""
    n = len(ps)
    arcs: list[list[tuple[int, float, str | None]]] = [[(i + 1, 0.0, None)] for i in range(n)]
    for i, p in enumerate(ps):
        w = p.core.lower()
        for k in (f"t:{w}",) if is_half(ps, i, lead) else (f"t:{w}", f"r:{w}"):
            if (got := facts.get(k)) and got[1] is not None and not joins.get(i) and not joins.get(i + 1):
                arcs[i].append((i + 1, -gains.get(k, CONFUSED), got[1]))
        if i + 1 in joins:
            arcs[i].append((i + 2, -HYPHEN - CONFUSED * bool(joins[i + 1]), joins[i + 1]))
    # Pages of which no run is one word need no look at them.
    for i, end in mergeable(ps) if any(k[0] == "m" for k in facts) else ():
        k = f"m:{merged_key(ps[i:end])}"
        if not (i == 0 and lead) and (got := facts.get(k)) and got[1] is not None:
            arcs[i].append((end, -gains.get(k, 0.0), got[1]))
    best: list[float] = [0.0] + [float("inf")] * n
    came: list[tuple[int, str | None]] = [(0, None)] * (n + 1)
    for i in range(n):
        for end, cost, right in arcs[i]:
            if best[i] + cost < best[end]:
                best[end], came[end] = best[i] + cost, (i, right)
    out, end = [], n
    while end:
        i, right = came[end]
        out.append((i, end, right))
        end = i
    return out[::-1]


def line_cores(line: str) -> set[str]:
    """The words of a line as they stand in ``pieces``."""
    line = line.rstrip()
    return {core.lower() for w in (line[:-1] if broken(line) else line).split() for _, core in token_parts(w)[0]}


def decode(
    lines: list[str], skip: set[int], follow: str, facts: dict[str, tuple[int, str | None]], scanned: bool, mend: bool = True, lead: bool = False, gains: dict[str, float] | None = None
) -> tuple[list[tuple[int, str]], list[list[str]]]:
    """One page: (line number, kind) of its broken and misread lines, and its lines repaired, each as
    (text, joined to the next), empty unless ``mend``. facts: "t:word" and "h:compound" -> count, with a misreading's
    original; "r:word" -> the words that ran together; "m:words" -> the word they are parts of; "s:strokes" -> count and word
    of the most frequent of a group. gains: of the repairs, how much likelier they are than the text as it stands."""
    at = content_lines(lines, skip)
    found: set[tuple[int, str]] = set()
    hows: dict[int, str] = {}
    joined: dict[int, str | None] = {}  # by the line after the hyphen
    for n, i in enumerate(at):
        if b := broken(lines[i]):
            nxt = first_word(lines[at[n + 1]]) if n + 1 < len(at) else follow
            joined_next, noise, where = join(*b, nxt, facts, scanned)
            hows[i] = "join" if joined_next else "hyphen"
            if n + 1 < len(at) and joined_next:
                joined[at[n + 1]] = facts[f"s:{strokes(b[0].lower() + nxt.lower())}"][1] if where else None
            if noise:
                found.add((i + 1, "hyphen"))
            if scanned and where:
                if "l" in where:
                    found.add((i + 1, "ocr"))
                if "r" in where and n + 1 < len(at):
                    found.add((at[n + 1] + 1, "ocr"))
    changes: dict[int, list[tuple[int, int, str]]] = {}
    # Only lines with a word that has a repair, with their neighbours; all if a word goes on from the page before.
    doubtful = {w for k, (_, best) in facts.items() if best is not None and k[0] in "trm" for w in k[2:].split(" ")} if scanned else set()
    hot = {i for i in at if i in joined or not doubtful.isdisjoint(line_cores(lines[i]))} if doubtful or joined else set()
    for stretch in ([at] if lead and hot else near(at, hot)) if scanned else ():
        ps = pieces(lines, stretch)
        halves = {j: joined[p.line] for j, p in enumerate(ps) if p.gap == "h" and j and p.line in joined}
        for i, end, right in segments(ps, facts, gains or {}, lead, halves):
            if right is None:
                continue
            part = ps[i:end]
            if end == i + 1 and not is_half(ps, i, lead):
                found.add((part[0].line + 1, "ocr"))
            for p, q in zip(part, part[1:], strict=False):
                found.add((p.line + 1, "hyphen" if q.gap == "h" else "ocr"))
            core = part[0].core
            right = right.upper() if core.isupper() and len("".join(p.core for p in part)) > 1 and all(p.core.isupper() for p in part) else right[:1].upper() + right[1:] if core[:1].isupper() else right
            first = [p for p in part if p.line == part[0].line]
            rest = part[len(first) :]
            at_cut = min(len(right) - 1, sum(len(p.core) for p in first)) if rest else len(right)
            changes.setdefault(first[0].line, []).append((first[0].start, first[-1].end, right[:at_cut]))
            if rest:
                changes.setdefault(rest[0].line, []).append((rest[0].start, rest[-1].end, right[at_cut:]))
                hows[first[0].line] = "join"
    out: list[list[str]] = []
    for i in at if mend else ():
        line = lines[i].rstrip("\r")
        for start, end, right in sorted(changes.get(i, ()), reverse=True):
            line = line[:start] + right + line[end:]
        out.append([line, hows.get(i, "")])
    return sorted(found), out


def join(left: str, sign: str, right: str, facts: dict, scanned: bool) -> tuple[bool, bool, str]:
    """Whether the halves of a broken word belong together without a hyphen, whether the hyphen is
    noise, and in which half there is a misreading."""
    a, b = left.lower(), right.lower()
    if not b:
        known = facts.get(f"t:{a}", (0, None))[0]
        noise = sign in ODD_HYPHENS or known < LEAST_COUNT
        return noise, noise, ""
    if not b[0].isalpha() and not scanned:
        return False, False, ""
    whole, n_joined = a + b, facts.get(f"t:{a}{b}", (0, None))[0]
    n_hyphen = facts.get(f"h:{a}-{b}", (0, None))[0]
    n_best, best = facts.get(f"s:{strokes(whole)}", (0, None))
    wrong = ""
    if best and best != whole and n_best >= LEAST_COUNT and n_joined <= RARE_SHARE * n_best:
        wrong = "r" if best.startswith(a) else "l" if best.endswith(b) else "lr"
        n_joined = max(n_joined, n_best)
    if n_joined or n_hyphen:
        noise = n_joined >= n_hyphen
        return noise, noise, wrong if noise else ""
    if sign in ODD_HYPHENS:
        return True, True, ""
    noise = min(facts.get(f"t:{a}", (0, None))[0], facts.get(f"t:{b}", (0, None))[0]) < LEAST_COUNT
    return noise, noise, ""


def number_misread(w: str) -> str | None:
    """The number that a word with digits and letters can stand for."""
    if not re.search(r"\d", w) or not re.search(r"[lIiOoSsZB|gqb]", w) or not re.fullmatch(r"[$]?[\dlIiOoSsZB|gqb.,%]+", w):
        return None
    d = as_digits(w)
    return d if _NUMBER.fullmatch(d) and d != w else None


_ITEM = re.compile(r"(?:[-*•]|\d+[.)])\s")


def _is_fragment(line: str, width: int) -> bool:
    """Whether a line can hardly be a paragraph by itself: no sentence, no item, and no short line with a capital."""
    return line[-1:] not in ".!?:\"”)" and not _ITEM.match(line) and (line[:1].islower() or len(line) >= 0.85 * width)


def paragraphs(lines: list[list[str]], blank_before: list[bool]) -> list[str]:
    """Repaired lines to paragraphs. Dynamic programming over the lines: a boundary costs little
    after a blank line, or a short line that ends a sentence, and much inside a sentence; a paragraph of one line
    costs more, unless it is a title, an item of a list or a whole sentence, so boundaries depend on each other."""
    n = len(lines)
    if not n:
        return []
    texts = [x[0].strip() for x in lines]
    width = max(1, sorted(map(len, texts))[int(0.8 * (n - 1))])
    # The least cost up to a line that begins a paragraph, or goes on with one, and whether the line before it began one.
    begin, go = [0.0] * n, [float("inf")] * n
    came: list[tuple[bool, bool]] = [(True, True)] * n
    for i in range(1, n):
        above, here = texts[i - 1], texts[i]
        ends = above[-1:] in ".!?:\"”)" and not lines[i - 1][1]
        boundary = 2.0 - 3.0 * blank_before[i] - 1.5 * (ends and len(above) < 0.85 * width) - 3.0 * bool(_ITEM.match(here))
        boundary += 4.0 * bool(lines[i - 1][1]) + 2.5 * (here[:1].islower() and not ends)
        after_one = begin[i - 1] + LONE * _is_fragment(above, width)
        came[i] = (after_one <= go[i - 1], begin[i - 1] <= go[i - 1])
        begin[i], go[i] = min(after_one, go[i - 1]) + boundary, min(begin[i - 1], go[i - 1])
    state, cuts = begin[-1] + LONE * _is_fragment(texts[-1], width) < go[-1], []
    for i in range(n - 1, 0, -1):
        if state:
            cuts.append(i)
        state = came[i][0 if state else 1]
    out, at = [], 0
    for end in [*sorted(cuts), n]:
        text = ""
        for line, how in lines[at:end]:
            line = " ".join(line.split())
            if how == "join":
                text += line.rstrip(HYPHENS + " ")
            elif how == "hyphen":
                text += line.rstrip(HYPHENS + " ") + "-"
            else:
                text += line + " "
        out.append(text.strip())
        at = end
    return [p for p in out if p]


# --- the plan -------------------------------------------------------------------------------------


def _rows(f: Callable[[dict], list[tuple]], names: list[str], schema: str, df: DataFrame) -> DataFrame:
    """Python rows per page, Arrow batches in and out."""
    return _streamed(lambda batches: (x for b in batches for row in b.to_pylist() for x in f(row)), names, schema, df)


def _streamed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], names: list[str], schema: str, df: DataFrame) -> DataFrame:
    """Python rows of all batches of a task, passed on by 20,000."""
    types = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = f(batches)
        while out := list(islice(rows, 20_000)):
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, types)


def _edges(row: dict) -> list[tuple]:
    lines = row["text"].split("\n")
    at = [i for i, line in enumerate(lines) if line.strip()]
    trace = any(c in row["text"] for c in _TRACES) and bool(_TRACE.search(row["text"]))
    edges = {*at[:EDGE], *at[-EDGE:]}
    out = []
    # One line more than the edges have: whatever of them is taken away, the first and the last of the rest are here.
    for i in sorted({*at[: EDGE + 1], *at[-EDGE - 1 :]}):
        number = i in edges and is_page_number(lines[i], row["page_no"] or 0)
        forms = [] if number or i not in edges else head_forms(lines[i], row["page_no"] or 0)
        first, ends_broken = first_word(lines[i]), broken(lines[i]) is not None
        for form, strict, title in forms or [(None, False, False)]:
            out.append((row["page_key"], row["file_id"], row["page_no"], row["h"], i + 1, number, form, mask(form, row["file_id"] or "") if form else None, strict, title, trace, first, ends_broken))
    return out


def noise_lines(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (page_key, file_id, page_no, text, h): (page_key, file_id, page_no, h, line_no, kind, trace, first, cut) of the lines
    at the edges (first word and whether it ends in a broken one), kind null but for heads and page numbers; and (file_id, scanned)."""
    edges = cut(
        _rows(
            _edges,
            ["page_key", "file_id", "page_no", "h", "line_no", "number", "form", "masked", "strict", "title", "trace", "first", "cut"],
            "page_key long, file_id string, page_no int, h long, line_no int, number boolean, form string, masked string, strict boolean, title boolean, trace boolean, first string, cut boolean",
            pages,
        )
    )
    sizes = pages.groupBy("file_id").agg(F.count("*").alias("n_pages"))
    forms = edges.where(F.col("form").isNotNull()).groupBy("file_id", "form", "masked", "strict").agg(
        F.count("*").alias("n"), F.bool_or("title").alias("title")
    )
    shared = forms.where("title").select("masked", "file_id").distinct().groupBy("masked").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= HEAD_FILES)
    heads = cut(
        forms.join(hint_small(sizes, SMALL_ROWS), F.equal_null(forms.file_id, sizes.file_id))
        .drop(sizes.file_id)
        .join(shared, "masked", "left")
        .where(F.col("strict") & (((F.col("n") >= HEAD_PAGES) & (F.col("n") >= HEAD_SHARE * F.col("n_pages"))) | ((F.col("title") | F.col("masked").contains("@")) & F.col("n_files").isNotNull())))
        .select("file_id", "form")
        .distinct()
    )
    # Damaged heads: at most 2 * EDGE / HEAD_SHARE heads of one file recur on that share of its pages.
    like = (
        forms.alias("f")
        .join(hint_small(heads.select("file_id", F.col("form").alias("head")), SMALL_ROWS).alias("h"), F.equal_null("f.file_id", "h.file_id"))
        .where(F.abs(F.length("form") - F.length("head")) <= 8)
        .where((F.col("form") == F.col("head")) | close(F.col("form"), F.col("head")))
        .select(F.col("f.file_id").alias("file_id"), "form")
        .distinct()
    )
    like = cut(like)
    lines = (
        edges.alias("e")
        .join(hint_small(like, SMALL_ROWS).alias("l"), F.equal_null("e.file_id", "l.file_id") & (F.col("e.form") == F.col("l.form")), "left")
        .groupBy("page_key", F.col("e.file_id").alias("file_id"), "page_no", "h", "line_no")
        .agg(
            F.max(F.when(F.col("number"), "page_number").when(F.col("l.form").isNotNull(), "header")).alias("kind"),
            F.bool_or("trace").alias("trace"), F.max("first").alias("first"), F.bool_or("cut").alias("cut"),
        )
    )
    lines = cut(lines)
    files = lines.groupBy("file_id").agg((F.bool_or("trace") | F.bool_or(F.col("kind").isNotNull())).alias("scanned"))
    return lines, files


class Sieve:
    """A set of strings as bits by their checksum: what it holds is found, and now and then something else.
    Its size is bounded, whatever the corpus has; exact joins follow."""

    def __init__(self, bits: bytes):
        self.bits, self.mask = bits, len(bits) * 8 - 1

    def __contains__(self, s: str) -> bool:
        h = zlib.crc32(s.encode("utf-8", "replace")) & self.mask
        return bool(self.bits[h >> 3] >> (h & 7) & 1)


def sieves(rows: DataFrame, kinds: int, words: int) -> list[Sieve]:
    """A sieve for each kind (from 0) of (kind, key), for a corpus of so many words."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (WORD_BITS * words).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [bytearray(bits // 8) for _ in range(kinds)]
        for b in batches:
            for kind, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = zlib.crc32(key.encode("utf-8", "replace")) & (bits - 1)
                sets[kind][h >> 3] |= 1 << (h & 7)
        yield pa.RecordBatch.from_arrays([pa.array(range(kinds), pa.int32()), pa.array(map(bytes, sets), pa.binary())], ["kind", "bits"])

    all_sets = [np.zeros(bits // 8, np.uint8) for _ in range(kinds)]
    for r in rows.where(F.col("key").isNotNull()).select("kind", "key").coalesce(4).mapInArrow(run, "kind int, bits binary").toLocalIterator():
        all_sets[r.kind] |= np.frombuffer(bytes(r.bits), np.uint8)
    return [Sieve(x.tobytes()) for x in all_sets]


def left_out(lines: list[str], at: list[int], lead: bool) -> Iterator[tuple[list[str], list[str]]]:
    """Of the lines that end in a broken word or follow such a line: the words that don't count, and all words that pieces() may have there."""
    after = lead
    for i in at:
        cut_end, line = broken(lines[i]) is not None, lines[i].rstrip()
        if (trimmed := broken(line) is not None) or after:
            ws = split_words(line)
            yield ws[:1] * after + ws[max(len(ws) - 1, int(after)) :] * cut_end, ws + split_words(line[:-1]) * trimmed
        after = cut_end


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows (word, compound, strokes, clean, scan) of pages, by ``countable``; 0 for words that stand in broken lines only."""
    tokens: tuple[Counter, Counter] = (Counter(), Counter())
    less: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> Iterator[tuple]:
        seen: dict[tuple[str, bool], list[int]] = {}
        for s in (0, 1):
            for token, n in tokens[s].items():
                for w in split_words(token):
                    seen.setdefault((w.lower(), False), [0, 0])[s] += n
                if "-" in token:
                    for c in compounds(token):
                        seen.setdefault((c, True), [0, 0])[s] += n
            for w, n in less[s].items():
                seen.setdefault((w, False), [0, 0])[s] -= n
            tokens[s].clear()
            less[s].clear()
        for (w, c), (clean, scan) in seen.items():
            yield w, c, "" if c else strokes(w), clean, scan

    for b in batches:
        for row in b.select(["text", "skip", "scanned", "lead"]).to_pylist():
            text, s = row["text"], int(bool(row["scanned"]))
            if row["skip"] or row["lead"] or _CUT.search(text):
                lines = text.split("\n")
                at = content_lines(lines, set(row["skip"] or ()))
                text = "\n".join([lines[i] for i in at])
                for out, there in left_out(lines, at, bool(row["lead"])):
                    for w in out:
                        less[s][w.lower()] += 1
                    for w in there:
                        less[s][w.lower()] += 0
            tokens[s].update(text.split())
            if len(tokens[0]) + len(tokens[1]) > COUNTED:
                yield from flush()
    yield from flush()


class _Memo(dict):
    """What a function says of a token, kept up to a bound."""

    def __init__(self, f: Callable[[str], object]):
        self.f = f

    def __missing__(self, w: str) -> object:
        if len(self) > COUNTED:
            self.clear()
        got = self[w] = self.f(w)
        return got


def _look_batches(batches: Iterator[pa.RecordBatch], odd: Sieve, wholes: Sieve, wrong: Sieve, sides: Sieve, lefts: Sieve, rights: Sieve) -> Iterator[tuple]:
    """(page_key, keys, other, words, size, strokes, m): what pages must know (keys of words and runs that may be wrong; for
    each broken word its halves, its whole and its strokes), and runs of words with their strokes if they may be one word and with how often they occur."""

    def ask(w: str) -> tuple[str, ...]:
        return tuple(x for x in dict.fromkeys(p.lower() for p in split_words(w)) if x in wrong)

    def about(w: str) -> int:  # 1: it has a word that may be a part of another, 2: dashes only, 4: it has a word that may be wrong
        parts = token_parts(w)[0]
        return (1 if any(core and core.lower() in odd for _, core in parts) else 0) | (0 if parts else 2) | (4 if asks[w] else 0)

    def ends(w: str) -> tuple[str | None, str | None, str, str, bool, bool, bool, bool]:
        parts, is_open = token_parts(w)
        first = parts[0][1].lower() if parts and parts[0][1] and not parts[0][0] and _is_letters(parts[0][1]) else None
        last = parts[-1][1].lower() if is_open and _is_letters(parts[-1][1]) else None
        a, b = first or "", last or ""
        return first, last, strokes(a), strokes(b), a in odd, b in odd, a in rights, b in lefts

    def may_merge(stream: list[str], j: int) -> bool:
        """Whether a token and its neighbours, two on either side at most, may be parts of one word."""
        first, last, st_first, st_last = both[stream[j]][:4]
        before = after = None
        if j and first is not None:
            before = both[stream[j - 1]]
            if before[1] is not None:
                if before[3] + st_first in wholes:
                    return True
                if j > 1 and before[0] is not None and (far := both[stream[j - 2]])[1] is not None and far[3] + before[3] + st_first in wholes:
                    return True
        if j + 1 < len(stream) and last is not None:
            after = both[stream[j + 1]]
            if after[0] is not None:
                if st_last + after[2] in wholes:
                    return True
                if j + 2 < len(stream) and after[1] is not None and (far := both[stream[j + 2]])[0] is not None and st_last + after[2] + far[2] in wholes:
                    return True
        return bool(before and after and before[1] is not None and after[0] is not None and before[3] + st_first + after[2] in wholes)

    asks, kinds, both = _Memo(ask), _Memo(about), _Memo(ends)
    is_odd = _Memo(odd.__contains__)
    pairs: Counter = Counter()
    runs3: Counter = Counter()

    def flush() -> Iterator[tuple]:
        found: Counter = Counter()
        for (v, w), n in pairs.items():
            _, a, _, sa, _, a_odd, _, is_left = both[v]
            b, _, sb, _, b_odd, _, is_right, _ = both[w]
            if a is not None and b is not None and (is_left and is_right and f"{a} {b}" in sides or (a_odd or b_odd) and sa + sb in wholes):
                found[f"{a} {b}"] += n
        pairs.clear()
        for k, n in found.items():
            yield None, None, None, k, 2, None, n
        for (k, size, st), n in runs3.items():
            yield None, None, None, k, size, st, n if size > 2 else 0
        runs3.clear()

    for b in batches:
        for row in b.select(["page_key", "text", "skip", "scanned", "follow", "lead"]).to_pylist():
            text, scanned = row["text"], bool(row["scanned"])
            lines = text.split("\n")
            at = content_lines(lines, set(row["skip"] or ()))
            words: set[str] = set()
            other: set[str] = set()
            hot: set[int] = set()
            kept: list[str] = []  # the lines as they part words, with a sign where two of them don't follow each other
            places: list[int] = []
            trimmed: list[int] = []
            before, was_cut = -2, False
            for n, i in enumerate(at):
                line = lines[i].strip()
                at_cut, was_cut = was_cut, False
                if i != before + 1:
                    kept.append("\0")
                    places.append(-1)
                before = i
                if line[-1] in HYPHENS:
                    if cut_at := broken(lines[i]):
                        left, right = cut_at[0].lower(), (first_word(lines[at[n + 1]]) if n + 1 < len(at) else row["follow"] or "").lower()
                        other |= {f"q:{left}", f"q:{right}", f"q:{left}{right}", f"h:{left}-{right}", f"s:{strokes(left + right)}"}
                        before, at_cut, was_cut = -2, True, True
                    if broken(line):
                        if scanned:
                            words.update(asks[line.split()[-1]])
                        line, at_cut = line[:-1], True
                        trimmed.append(len(kept))
                if line[0] in "-/—–" and not token_parts(line.split(None, 1)[0])[0]:  # dashes part no words, but at the beginning of a line
                    line = "\0 " + line
                if at_cut and scanned and any(kinds[w] & 1 for w in line.split()):  # parts may lie on either side of the hyphen
                    hot.add(i)
                kept.append(line)
                places.append(i)
            stream = _WIDE.sub(" \0 ", "\n".join(kept)).split()
            says = list(map(kinds.__getitem__, stream))
            spots: list[int] = []
            if any(says):
                if scanned:
                    unasked = set()
                    if trimmed:  # their last words were asked for with the hyphen
                        ends_at = list(accumulate(len(_WIDE.sub(" \0 ", x).split()) for x in kept))
                        unasked = {ends_at[x] - 1 for x in trimmed}
                    for j, k in enumerate(says):
                        if k & 4 and j not in unasked:
                            words.update(asks[stream[j]])
                if any(k & 2 for k in says):
                    stream = [w for k, w in zip(says, stream, strict=True) if not k & 2]
                    says = [k for k in says if not k & 2]
                spots = [j for j, k in enumerate(says) if k & 1] if scanned else []
            pairs.update(zip(stream, stream[1:]))
            if spots := [j for j in spots if may_merge(stream, j)]:
                ends_at = list(accumulate(sum(not kinds[w] & 2 for w in _WIDE.sub(" \0 ", x).split()) for x in kept))
                hot.update(places[bisect_right(ends_at, j)] for j in spots)
            parts: set[tuple[str, int, str]] = set()
            for stretch in near(at, hot) if scanned else ():
                ps = pieces(lines, stretch)
                low = [p.core.lower() for p in ps]
                odd_ones = [is_odd[w] for w in low]
                for i, end in mergeable(ps) if any(odd_ones) else ():
                    if any(odd_ones[i:end]) and (st := "".join(map(strokes, low[i:end]))) in wholes:
                        parts.add((" ".join(low[i:end]), end - i, st))
            runs3.update(parts)
            if words or other or parts:
                yield row["page_key"], [*(f"t:{w}" for w in sorted(words)), *sorted({f"m:{k}" for k, _, _ in parts})], sorted(other), None, None, None, None
            if len(pairs) > COUNTED or len(runs3) > COUNTED:
                yield from flush()
    yield from flush()


def _halves(row: dict, known: Sieve) -> list[tuple]:
    """The ways to cut a word in two of which both halves may have strokes of a known word: (word, its count, halves, their strokes)."""
    w = row["word"]
    cuts = ((w[:k], w[k:]) for k in range(1, len(w) - 1) if k > 1 or w[0] == "a")
    return [(w, row["n"], a, b, sa, sb) for a, b in cuts if (sa := strokes(a)) in known and (sb := strokes(b)) in known]


def prepared(pages: DataFrame, all_pages: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pages with all that decoding needs: skip (heads and numbers), scanned, follow (the next page's
    first word), lead (whether the page before ends in a broken word) and facts; and the lines of heads and page numbers.
    Unless all_pages, pages without broken words and without any word that may be wrong are left out."""
    pages = pages.where(F.col("text_list").isNotNull()).select("page_key", "file_id", "page_no", F.col("text_list").alias("text")).withColumn("h", F.xxhash64("page_key", "file_id", "page_no", "text"))
    # Only what may have been delivered again is compared: most pages are never moved for that.
    again = cut(pages.groupBy("h").count().where("count > 1").select("h"))
    n_again = again.count()
    if n_again > REPEATED_ROWS:
        pages = pages.distinct()
    elif n_again:
        pages = pages.join(F.broadcast(again), "h", "left_anti").unionByName(pages.join(F.broadcast(again), "h", "left_semi").distinct())
    lines, files = noise_lines(pages)
    own = F.col("kind").isNull()
    edges = (
        lines.groupBy("page_key", "file_id", "page_no", "h")
        .agg(
            F.collect_list(F.when(~own, F.col("line_no"))).alias("skip"),
            F.min(F.when(own, F.struct("line_no", "first"))).alias("first"),
            F.max(F.when(own, F.struct("line_no", "cut"))).alias("last"),
        )
        .alias("p")
        .join(hint_small(files, SMALL_ROWS).alias("f"), F.equal_null("p.file_id", "f.file_id"), "left")
        .select("p.*", F.coalesce("scanned", F.lit(False)).alias("scanned"))
    )
    edges = cut(edges)
    nexts = edges.where("first is not null").groupBy("file_id", (F.col("page_no") - 1).alias("page_no")).agg(F.min("first.first").alias("follow"))
    leads = edges.where("last.cut").select("file_id", (F.col("page_no") + 1).alias("page_no"), F.lit(True).alias("lead")).distinct()
    edges = edges.join(nexts, ["file_id", "page_no"], "left").join(leads, ["file_id", "page_no"], "left")
    key = ("h", "page_key", "file_id", "page_no")
    path = scratch(pages.sparkSession, "pages")
    (
        pages.alias("p")
        .join(edges.select(*key, "skip", "scanned", "follow", "lead").hint("shuffle_hash").alias("e"), reduce(Column.__and__, [F.equal_null(f"p.{c}", f"e.{c}") for c in key]), "left")
        .select("p.page_key", "text", "skip", F.coalesce("scanned", F.lit(False)).alias("scanned"), "follow", "lead")
        .write.option("compression", "zstd")
        .parquet(path)
    )
    known = pages.sparkSession.read.parquet(path)
    words = cut(
        _streamed(_count_batches, ["word", "compound", "strokes", "clean", "scan"], "word string, compound boolean, strokes string, clean long, scan long", known)
        .groupBy("word", "compound", "strokes")
        .agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan"))
        .select("*", (F.col("clean") + F.col("scan")).alias("n"))
    )
    singles = words.where(~F.col("compound") & (F.col("n") > 0))
    groups = singles.groupBy("strokes").agg(F.max_by("word", F.struct("n", "word")).alias("best"), F.max("n").alias("n_best"))
    totals = singles.agg(F.sum("clean").alias("c"), F.sum("scan").alias("s"), F.count("*").alias("words")).first()
    rate = (totals.s or 0) / max(1, totals.c or 0)
    unborne = F.col("clean") * rate <= CLEAN_SHARE * F.col("scan")
    foreign_mark = F.col("word").rlike(r"[¢†ſ|^`~]")
    bad = (
        singles.join(groups, "strokes")
        .where((F.col("word") != F.col("best")) & F.col("best").rlike(r"^[\p{L}'’.]+$") & F.col("word").rlike(r"[\p{L}¢†|]"))
        .where(((F.length("strokes") >= 3) | F.col("word").rlike(r"\d") | foreign_mark) & unborne & (F.col("n_best") >= LEAST_COUNT) & ((F.col("n") <= RARE_SHARE * F.col("n_best")) | (foreign_mark & (F.col("n") <= F.col("n_best")))))
        .select(F.concat(F.lit("t:"), "word").alias("k"), "n", "best", F.greatest(F.lit(0.5), F.log(F.col("n_best") / (F.col("n") + 1)) - CONFUSED).alias("gain"))
    )
    numbers = (
        singles.where(F.col("word").rlike(r"\d") & F.col("word").rlike(r"[lioszb|gq]"))
        .where(unborne)
        .select("word", "n", _number("word").alias("best"))
        .where(F.col("best").isNotNull())
    )
    numbers = (
        numbers.join(singles.select(F.col("word").alias("best"), F.col("n").alias("m")), "best", "left")
        .where(F.col("n") <= F.greatest(F.coalesce("m", F.lit(0)), F.lit(1)))
        .select(F.concat(F.lit("t:"), "word").alias("k"), "n", "best", F.lit(CONFUSED).alias("gain"))
    )
    single_wrong = cut(bad.unionByName(numbers))
    # Words that ran together: rare and unborne, of two known words; and both halves stand side by side elsewhere.
    known_strokes = sieves(singles.where(F.col("n") >= LEAST_COUNT).select(F.lit(0).alias("kind"), F.col("strokes").alias("key")), 1, totals.words)[0]
    halves = cut(
        _rows(
            partial(_halves, known=known_strokes),
            ["word", "n", "a", "b", "sa", "sb"],
            "word string, n long, a string, b string, sa string, sb string",
            singles.where(unborne & (F.col("scan") > 0) & F.col("word").rlike(rf"^[\p{{L}}¢†|^`~]{{{LEAST_LETTERS},{MOST_LETTERS}}}$")).select("word", "n"),
        )
    )
    group = groups.where(F.col("best").rlike(r"^\p{L}+$"))
    counts = singles.where(F.col("n") >= LEAST_COUNT)
    options = cut(
        halves.select("word", "n", F.col("a").alias("xa"), F.col("b").alias("xb"), F.lit(0).alias("changed"))
        .unionByName(
            halves.join(group.select(F.col("strokes").alias("sa"), F.col("best").alias("xa")), "sa")
            .join(group.select(F.col("strokes").alias("sb"), F.col("best").alias("xb")), "sb")
            .select("word", "n", "xa", "xb", ((F.col("xa") != F.col("a")).cast("int") + (F.col("xb") != F.col("b")).cast("int")).alias("changed"))
        )
        .join(counts.select(F.col("word").alias("xa"), F.col("n").alias("na")), "xa")
        .join(counts.select(F.col("word").alias("xb"), F.col("n").alias("nb")), "xb")
        .where(F.col("n") <= RARE_SHARE * F.least("na", "nb"))
        .withColumn("gain", F.log(F.least("na", "nb") / (F.col("n") + 1)) - RUN_ON - CONFUSED * F.col("changed"))
        .where("gain > 0")
    )
    wholes = groups.where(F.col("best").rlike(r"^\p{L}+$") & (F.length("best") >= LEAST_LETTERS) & (F.col("n_best") >= LEAST_COUNT))
    keys = (
        words.where(~F.col("compound") & unborne).select(F.lit(0).alias("kind"), F.col("word").alias("key"))
        .unionByName(wholes.select(F.lit(1).alias("kind"), F.col("strokes").alias("key")))
        .unionByName(single_wrong.select(F.lit(2).alias("kind"), F.substring("k", 3, 1 << 20).alias("key")))
        .unionByName(options.select(F.lit(2).alias("kind"), F.col("word").alias("key")))
        .unionByName(options.select(F.lit(3).alias("kind"), F.concat_ws(" ", "xa", "xb").alias("key")))
        .unionByName(options.select(F.lit(4).alias("kind"), F.col("xa").alias("key")))
        .unionByName(options.select(F.lit(5).alias("kind"), F.col("xb").alias("key")))
    )
    odd, whole_strokes, wrong_words, sides, lefts, rights = sieves(keys, 6, totals.words)
    looked = cut(
        _streamed(
            partial(_look_batches, odd=odd, wholes=whole_strokes, wrong=wrong_words, sides=sides, lefts=lefts, rights=rights),
            ["page_key", "keys", "other", "words", "size", "strokes", "m"],
            "page_key long, keys array<string>, other array<string>, words string, size int, strokes string, m long",
            known,
        )
    )
    asked = looked.where("words is null")
    runs = looked.where("words is not null").groupBy("words", "size").agg(F.max("strokes").alias("strokes"), F.sum("m").alias("m"))
    # Parts of one word: the whole is frequent, and a part by itself is rare against it and unborne.
    whole = runs.where(F.col("strokes").isNotNull()).join(wholes, "strokes").where(F.col("m") <= RARE_SHARE * F.col("n_best"))
    parts = (
        whole.select("words", "m", "best", "n_best", F.explode(F.split("words", " ")).alias("word"))
        .join(singles.select("word", "n", "clean", "scan"), "word", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("odd", (F.col("n") <= RARE_SHARE * F.col("n_best")) & F.coalesce(unborne, F.lit(True)))
        .groupBy("words", "m", "best", "n_best")
        .agg(F.min(F.when(F.col("odd"), F.col("n"))).alias("n"))
        .where(F.col("n").isNotNull())
    )
    same = F.col("best") == F.replace("words", F.lit(" "), F.lit(""))
    parts = parts.select(
        F.concat(F.lit("m:"), "words").alias("k"), "n", "best",
        (F.log(F.col("n_best") / (F.col("n") + 1)) - STRAY - F.when(same, 0.0).otherwise(CONFUSED)).alias("gain"),
    ).where("gain > 0")
    pair = F.split("words", " ")
    ran = (
        options.join(runs.where("size = 2").select(pair[0].alias("xa"), pair[1].alias("xb"), "m"), ["xa", "xb"])
        .where(F.col("m") >= F.col("n"))
        .groupBy("word", "n")
        .agg(F.max(F.struct("gain", "m", F.concat_ws(" ", "xa", "xb").alias("best"))).alias("x"))
        .select(F.concat(F.lit("r:"), "word").alias("k"), "n", "x.best", "x.gain")
    )
    wrong = cut(
        single_wrong.unionByName(parts).unionByName(ran)
        .groupBy("k")
        .agg(F.max("n").alias("n"), F.min("best").alias("best"), F.max("gain").alias("gain"))
        .withColumn("ask", F.regexp_replace("k", "^r:", "t:"))
    )
    nothing = F.lit(None).cast("string")
    other = cut(
        singles.select(F.concat(F.lit("q:"), "word").alias("k"), "n", nothing.alias("best"))
        .unionByName(words.where("compound").select(F.concat(F.lit("h:"), "word").alias("k"), "n", nothing.alias("best")))
        .unionByName(groups.where(F.col("best").rlike(r"^\p{L}+$")).select(F.concat(F.lit("s:"), "strokes").alias("k"), F.col("n_best").alias("n"), "best"))
    )
    told = (
        asked.select("page_key", F.explode("keys").alias("ask")).join(hint_small(wrong, SMALL_ROWS), "ask").drop("ask")
        .unionByName(asked.select("page_key", F.explode("other").alias("k")).join(other, "k").withColumn("gain", F.lit(None).cast("double")))
        .unionByName(asked.select("page_key", nothing.alias("k"), F.lit(None).cast("long").alias("n"), nothing.alias("best"), F.lit(None).cast("double").alias("gain")))
        .groupBy("page_key")
        .agg(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n", "best", "gain"))).alias("facts"))
    )
    ready = known.alias("p").join(told.hint("shuffle_hash").alias("t"), F.equal_null("p.page_key", "t.page_key"), "left" if all_pages else "inner")
    return ready.select("p.*", "facts"), lines.where(~own).select("page_key", "line_no", "kind")


@F.pandas_udf(T.StringType())
def _number(words: pd.Series) -> pd.Series:
    return words.map(number_misread)


def _facts(row: dict) -> dict[str, tuple[int, str | None]]:
    out: dict[str, tuple[int, str | None]] = {}
    for f in row["facts"] or ():
        if f["k"].startswith("q:"):
            k = "t:" + f["k"][2:]
            out[k] = (f["n"], out.get(k, (0, None))[1])
        else:
            out[f["k"]] = (f["n"], f["best"])
    return out


def _gains(row: dict) -> dict[str, float]:
    return {f["k"]: f["gain"] for f in row["facts"] or () if f["gain"] is not None}


def _noise(row: dict) -> list[tuple]:
    found, _ = decode(row["text"].split("\n"), set(row["skip"] or ()), row["follow"] or "", _facts(row), bool(row["scanned"]), mend=False, lead=bool(row["lead"]), gains=_gains(row))
    return [(row["page_key"], n, k) for n, k in found]


def _clean(row: dict) -> list[tuple]:
    lines, skip = row["text"].split("\n"), set(row["skip"] or ())
    _, out = decode(lines, skip, row["follow"] or "", _facts(row), bool(row["scanned"]), lead=bool(row["lead"]), gains=_gains(row))
    at = content_lines(lines, skip)
    blank = [False] + [any(not lines[j].strip() for j in range(a + 1, b)) for a, b in zip(at, at[1:], strict=False)]
    return [(row["page_key"], i + 1, p) for i, p in enumerate(paragraphs(out, blank))]


def noise(pages: DataFrame) -> DataFrame:
    """(page_key, line_no, kind) of all lines with noise. Null pages have none; a page that came
    several times counts once. Pages without file or number have no heads or page numbers of their own
    found but are read like others. An empty table gives no rows."""
    ready, lines = prepared(pages, all_pages=False)
    return lines.unionByName(_rows(_noise, ["page_key", "line_no", "kind"], "page_key long, line_no int, kind string", ready)).distinct()


def repair(pages: DataFrame) -> DataFrame:
    """(page_key, paragraph_no, paragraph): each page's own text as continuous paragraphs. Words
    broken over a page's end stay open there. Null and blank pages have no paragraphs."""
    ready, _ = prepared(pages)
    return _rows(_clean, ["page_key", "paragraph_no", "paragraph"], "page_key long, paragraph_no int, paragraph string", ready)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with noise."""
    return noise(table(spark, sf_dir, "text_list"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages repaired."""
    return repair(table(spark, sf_dir, "text_list"))


QUERIES = {"p3_found": p3_found, "p3_paragraphs": p3_paragraphs}
#: Decoding isn't SQL; the tests plant noise in clean pages and look for it.
ORACLE: dict[str, str] = {}
