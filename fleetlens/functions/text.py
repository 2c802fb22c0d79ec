"""Text column helpers: response cleaning, labels and display cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the edge of a text.
EDGE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The markup of a model response, as regular expressions.
THINK_BLOCK = r"(?s)<think>.*?</think>"
FENCED_BLOCK = r"(?s)```(?:sql)?[" + EDGE_SPACE + r"]*\n?(.*?)```"

# Name prefixes ignored when result columns are matched, and how many
# characters must remain after one is removed.
NAME_PREFIXES = ("customer_", "account_manager_", "total_", "product_")
MIN_NAME_LEFT = 3


def strip(col: Column) -> Column:
    """Trim white space of every kind from both ends, not only blanks."""
    return F.btrim(col, F.lit(EDGE_SPACE))


def drop_think_blocks(col: Column) -> Column:
    return strip(F.regexp_replace(col, THINK_BLOCK, ""))


def first_fenced_block(col: Column) -> Column:
    """Body of the first fenced block, or the whole text where there is none."""
    return F.when(col.rlike(FENCED_BLOCK), F.regexp_extract(col, FENCED_BLOCK, 1)).otherwise(col)


def first_statement(col: Column) -> Column:
    """Text up to and including the first semicolon; all of it without one."""
    end = F.instr(col, ";")
    return F.when(end > 0, F.substring(col, F.lit(1), end)).otherwise(col)


def extract_sql(col: Column) -> Column:
    """Turn a raw model response into one SQL statement; null becomes ''."""
    text = drop_think_blocks(F.coalesce(col, F.lit("")))
    return first_statement(strip(first_fenced_block(text)))


def starts_with_select(col: Column) -> Column:
    return F.upper(strip(col)).startswith("SELECT")


def canonical_name(col: Column) -> Column:
    """Lower-case column name without its first known prefix.

    Only the first prefix that fits is tried, and only if enough is left."""
    name = strip(F.lower(col))
    out = F.when(F.lit(False), name)
    for prefix in NAME_PREFIXES:
        fits = name.startswith(prefix) & (
            F.length(name) >= len(prefix) + MIN_NAME_LEFT
        )
        out = out.when(fits, F.substring(name, F.lit(len(prefix) + 1), F.length(name)))
    return out.otherwise(name)


def padded_label(prefix: str, width: int, col: Column) -> Column:
    """`prefix` followed by the number, zero-padded to at least `width` digits."""
    return F.format_string(f"{prefix}%0{width}d", col)


def shorten(col: Column, length: int) -> Column:
    return F.substring(col, 1, length)
