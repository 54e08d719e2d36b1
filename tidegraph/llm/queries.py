"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("chunks", "ocr", "frequency", "names", "bpe", "packing", "residue")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    try:
        _module = importlib.import_module(f"tidegraph.llm.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"tidegraph.llm.{_name}":
            raise
        continue
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
