"""Pages of documents: sources, page selection, size guard, and trimming of heads and feet."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, OCR_BELOW = 10_000, 20


def read_text_pages(spark: SparkSession, path: str, page_break: str = "\f") -> DataFrame:
    """(file_id, page_no, text) of a folder of text files; pages end at form feeds."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_id"), "value")
    return files.select("file_id", F.posexplode(F.split("value", page_break)).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


def read_binary_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """(file_id, page_no, text) of binary files by a plug-in that gives a file's pages, one file a row.
    No extractor is part of the library."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pages(content: pd.Series) -> pd.Series:
        return content.map(lambda b: extract(bytes(b)))

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file_id"), pages("content").alias("p"))
    return named.select("file_id", F.posexplode("p").alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


def keep_pages(pages: DataFrame, keep: Sequence[bool] | Sequence[int] | None, beyond: str = "error") -> DataFrame:
    """Pages by number, or by a mask of one value or one per page of every file.

    Numbers below 1, beyond a file's last page or not whole are errors, as are masks of another length. With
    ``beyond="none"`` a shorter file gives those of the numbered pages that it has; then the files' lengths aren't read.
    """
    if beyond not in ("error", "none"):
        raise ValueError("beyond must be 'error' or 'none'")
    if keep is None:
        return pages
    keep = list(keep)
    masked = bool(keep) and all(isinstance(k, bool) for k in keep)
    if not masked:
        if any(isinstance(k, bool) or k != int(k) or k < 1 for k in keep):
            raise ValueError("page numbers must be whole and from 1")
        if beyond == "none":
            return pages.where(F.col("page_no").isin(*sorted({int(k) for k in keep})))
    lengths = pages.groupBy("file_id").agg(F.max("page_no").alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if masked:
        if len(keep) == 1:
            return pages if keep[0] else pages.limit(0)
        if lengths.a is not None and (lengths.a != len(keep) or lengths.b != len(keep)):
            raise ValueError("a mask must have one value, or one per page")
        keep = [i + 1 for i, k in enumerate(keep) if k]
    elif lengths.a is not None and max(keep, default=0) > lengths.a:
        raise ValueError("a page number is beyond the last page")
    return pages.where(F.col("page_no").isin(*sorted({int(k) for k in keep})))


def page_guard(pages: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """Longer pages become null: they're maps or tables that no parser can read."""
    return pages.withColumn(text, F.when(F.length(text) <= max_chars, F.col(text)))


def ocr_fallback(pages: DataFrame, read: Callable[[str, int], str], text: str = "text") -> DataFrame:
    """Pages of fewer than 20 characters are read again by a plug-in of (file_id, page_no)."""

    @F.pandas_udf(T.StringType())
    def again(files: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([read(f, int(n)) for f, n in zip(files, numbers, strict=True)])

    short = F.length(F.coalesce(text, F.lit(""))) < OCR_BELOW
    return pages.where(~short).unionByName(pages.where(short).withColumn(text, again("file_id", "page_no")))


_SMALL, _LONG, _BLANK = re.compile(r"\s[a-z]"), re.compile(r"\s[a-z]{7,}"), re.compile(r"\s*")
#: All dashes of Unicode, for a class of an expression.
_DASHES = re.escape("".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Pd"))
#: Fixed value: a page's number at its end, after "page" or a wide gap, as digits, small roman or like C-28.
_NUMBER = re.compile(rf"(?:[pP]age\s|\s{{3,}})(?:[0-9|xvi]{{1,6}}|[A-Za-z]+[{_DASHES}][0-9]+)\s*$")


def _prose(line: str, small: int, long: int) -> bool:
    return len(_SMALL.findall(line)) > small or len(_LONG.findall(line)) > long


def _gaps(lines: list[str]) -> list[int]:
    """The first of every run of blank lines, from 0."""
    blank = [bool(_BLANK.fullmatch(x)) for x in lines]
    return [i for i, b in enumerate(blank) if b and (i == 0 or not blank[i - 1])]


def _without_head(lines: list[str]) -> list[str]:
    """Titles before the first prose line, in the part of the page that can be a head."""
    if len(lines) > 6:
        gaps = _gaps(lines[:6])
        if gaps:
            size, small, long = gaps[-1], 6, 3
        else:
            size, small, long = 3, 8, 5
    else:
        blank = [i for i, x in enumerate(lines) if _BLANK.fullmatch(x)]
        size, small, long = (blank[0] + 1 if blank else len(lines)), 6, 3
    first = next((i for i in range(size) if _prose(lines[i], small, long)), size)
    return lines[first:]


def _without_foot(lines: list[str]) -> list[str] | None:
    """At most four lines of text below the last prose and a blank line; None if nothing is left."""
    gaps = _gaps(lines)
    n = len(lines)
    if not gaps:
        return lines
    start = max(gaps[0] if len(gaps) < 3 else gaps[-3], n - 7)
    prose = next((j for j in range(n - 1, start - 1, -1) if _prose(lines[j], 5, 2)), None)
    # Lines before the search began stay, and so do those above a prose line; alone at the very
    # beginning of the search, a prose line protects only itself.
    first = start if prose is None else prose + 1
    if first >= n:
        return lines
    at = max(first, n - 7)
    text = [i for i, x in enumerate(lines) if not _BLANK.fullmatch(x)]

    def below(c: int) -> int:
        return sum(i > c for i in text)

    for tries in (1, 2):
        if below(at) <= 4:
            break
        at = max(at, gaps[0] if len(gaps) < 3 - tries else gaps[tries - 3])
    if below(at) > 4:
        return lines
    return lines[:at] if at else None


def trim_page(text: str | None) -> str | None:
    """A page without head, foot and number; None for null pages and pages of which nothing stays."""
    if text is None:
        return None
    lines = _without_head(text.split("\n"))
    kept = _without_foot(lines) if lines else None
    return None if not kept else _NUMBER.sub("", "\n".join(kept), count=1)


def trim_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """``trim_page`` over a column, by Arrow batches: every page on its own, without a shuffle."""

    @F.pandas_udf(T.StringType())
    def trim(texts: pd.Series) -> pd.Series:
        return texts.map(trim_page)

    return pages.withColumn(text, trim(text))


def clean_pages(pages: DataFrame, keep: Iterable | None = None, max_chars: int = MAX_CHARS, trim: bool = True) -> DataFrame:
    """The whole way from raw to clean pages: selection, guard, trimming."""
    out = page_guard(keep_pages(pages, keep), "text", max_chars)
    return trim_pages(out) if trim else out
