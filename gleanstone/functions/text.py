"""Column expressions on text shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, as Python's ``str.split`` has it.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"


def collapse(text: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def is_blank(text: Column) -> Column:
    """True for null and for text of white space (and zero-width characters) only."""
    return text.isNull() | (F.regexp_replace(text, SPACE + r"+|[\x{200B}\x{FEFF}]", "") == "")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text with white space collapsed and letters lowered; null stays null."""
    return F.sha2(F.lower(collapse(text)), 256)


def first_of(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first condition that holds (null counts as false)."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
