"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator on doubles; null where the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")


def half_even_2(col: Column) -> Column:
    """Round a finite double to 2 places, half to even on its exact binary value.

    bround works on the shortest decimal text, so it takes 2.675 (stored slightly below)
    for a tie; a number format decides on the binary value.  It is dear, and only numbers
    near a tie need it: the error of a product below 10^11 is under a thousandth."""
    cents = col * 100
    plain = (F.abs(col) < 1e9) & (F.abs(F.abs(cents - F.rint(cents)) - 0.5) > 1e-3)
    exact = F.call_function("format_number", col, F.lit("0.00")).cast("double")
    return F.when(plain, F.rint(cents) / 100).otherwise(exact) + 0.0
