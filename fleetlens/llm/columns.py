"""Small column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column) -> Column:
    """Number of words as a long; null or empty: 0."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def hex_number(digits: Column) -> Column:
    """A string of hex digits as a long."""
    return F.conv(digits, 16, 10).cast("long")


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")
