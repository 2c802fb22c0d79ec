"""Calendar helpers.  Relative cutoffs are folded on the driver into literals, so
that a date filter reaches the Parquet scan as a plain comparison."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_before(as_of: date, days: int) -> date:
    return as_of - timedelta(days=days)


def months_before(as_of: date, months: int) -> date:
    """Same day `months` earlier, clamped to the last day of a shorter month."""
    year, month0 = divmod(as_of.year * 12 + as_of.month - 1 - months, 12)
    last_day = calendar.monthrange(year, month0 + 1)[1]
    return date(year, month0 + 1, min(as_of.day, last_day))


def in_year(col: Column | str, year: int) -> Column:
    """Half-open range instead of year(col) = n, which would block pushdown."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= F.lit(date(year, 1, 1))) & (c < F.lit(date(year + 1, 1, 1)))


def month_label(col: str) -> Column:
    return F.date_format(col, "yyyy-MM")


def quarter_label(col: str) -> Column:
    return F.concat(F.year(col).cast("string"), F.lit("-Q"), F.quarter(col).cast("string"))
