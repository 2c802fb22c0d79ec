"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.operators.ranking import in_ranges


def row_number_within(df: DataFrame, group: list[str], order: str, out: str) -> DataFrame:
    """Number from 0 within each group by `order`, which must be unique there.

    Rows are cut into ranges of (group, order), so a group larger than a task spreads
    over several ranges and is chained by its row count in each."""
    rows = in_ranges(df, [*map(F.col, group), F.col(order)])
    parts = rows.groupBy(*group, "__range").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first")
    )
    # One row per group and range: at most as many per group as there are ranges.
    chain = W.partitionBy(*group).orderBy("__range")
    starts = parts.select(
        *group, "__range", "__first", (F.sum("__n").over(chain) - F.col("__n")).alias("__before")
    )
    return rows.join(starts, [*group, "__range"]).select(
        *df.columns, (F.col("__before") + F.col("__place") - F.col("__first")).alias(out)
    )
