"""XML records as JSON text, one object per element, for the variant functions of Spark."""

from __future__ import annotations

import json
from collections.abc import Iterable
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def xml_to_json(text: str | None, keep: frozenset[str] | None = None) -> str | None:
    """The root element as {"tag": {"@attribute": value, "child tag": [child, ...]}}.

    Every child tag becomes an array, in document order, so that one occurrence and many have the
    same schema. Text content goes to "#text". With ``keep``, other elements are left out with all
    below them. None for null, empty and not well-formed records.
    """
    if text is None or not text.strip():
        return None
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    top: dict = {}
    stack: list[dict] = [top]
    skipping = 0

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal skipping
        if skipping or (keep is not None and tag not in keep):
            skipping += 1
            return
        node: dict = {f"@{k}": v for k, v in attributes.items()}
        stack[-1].setdefault(tag, []).append(node)
        stack.append(node)

    def end(tag: str) -> None:
        nonlocal skipping
        if skipping:
            skipping -= 1
        else:
            stack.pop()

    def chars(data: str) -> None:
        if not skipping and keep is None and data.strip():
            stack[-1]["#text"] = stack[-1].get("#text", "") + data

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    try:
        # A text column is already decoded: an encoding that the XML declaration names is overridden.
        parser.Parse(text.lstrip("﻿ \t\r\n").encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, UnicodeError, ValueError):
        return None
    return json.dumps(top, ensure_ascii=False)


def xml_column(c: Column, keep: Iterable[str] | None = None) -> Column:
    """``xml_to_json`` over a column, by Arrow batches."""
    kept = None if keep is None else frozenset(keep)

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: xml_to_json(t, kept))

    return convert(c)
