"""Cleaning of entity names as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mathematical italic small and capital letters, with U+210E in the place of h.
_MATH = "".join("ℎ" if i == 7 else chr(0x1D44E + i) for i in range(26)) + "".join(chr(0x1D434 + i) for i in range(26))
_PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_letters(c: Column) -> Column:
    return F.translate(c, _MATH, _PLAIN)


def clean_entities(c: Column, remove_nums: bool = True, remove_trailing_s: bool = True, concatenator: str = "_") -> Column:
    """An entity name without typefaces, possessive s, signs and stray concatenators.

    Names without a letter (or, unless ``remove_nums``, a letter or digit) and null names become ''.
    """
    join = re.escape(concatenator)
    c = plain_letters(c)
    if remove_trailing_s:
        c = F.regexp_replace(F.regexp_replace(c, "'s$", ""), f"{join}s$", "")
    c = F.regexp_replace(c, r"(?U)\W", "")
    c = F.regexp_replace(c, f"({join})(?:{join})+", "$1")
    c = F.regexp_replace(c, f"^(?:{join})|(?:{join})$", "")
    return F.when(c.rlike("[a-zA-Z]" if remove_nums else "[a-zA-Z0-9]"), c).otherwise("")


def entity_type(c: Column) -> Column:
    return F.regexp_replace(c, "_.+", "")


def entity_iob(c: Column) -> Column:
    return F.regexp_replace(c, ".+_", "")
