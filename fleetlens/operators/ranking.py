"""Global ranks over a whole table without gathering it in one task.

A window without a partition key moves every row to one task.  Here the rows are range
partitioned by (value, key) and sorted inside each range, so a row's place is its place
in the range plus the sizes of the ranges before it.  Because key is unique, even a
value shared by a third of all rows is cut into many ranges.

The ranges must be the same each time they are read, so a written table fixes them.
Only the given columns are written; callers pass narrow rows.  Where the value is a sum
of doubles, callers write it first: a sum computed again after a lost executor may differ
in its last bit and fall into another range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.sources.checkpoints import written_table

# monotonically_increasing_id() holds the partition number above bit 33 and the place
# inside the partition below it.
_PLACE_BITS = 33


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with __range and __place (from 0), fixed in a written table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = sorted_rows.withColumn("__id", F.monotonically_increasing_id())
    return (
        written_table(numbered)
        .withColumn("__range", F.shiftright("__id", _PLACE_BITS))
        .withColumn("__place", F.col("__id").bitwiseAND((1 << _PLACE_BITS) - 1))
        .drop("__id")
    )


def _by_range(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per range with its offset and the table's total.

    There are at most spark.sql.shuffle.partitions ranges, which bounds both the window
    below and the broadcast of this summary."""
    chain = W.orderBy("__range")
    return (
        df.groupBy("__range")
        .agg(F.count(F.lit(1)).alias("__n"), *aggregates)
        .withColumn("__offset", F.sum("__n").over(chain) - F.col("__n"))
        .withColumn("__total", F.sum("__n").over(W.partitionBy(F.lit(1))))
    )


def _order(value: str, key: str, descending: bool) -> list[Column]:
    return [F.desc_nulls_last(value) if descending else F.asc_nulls_first(value), F.col(key)]


def global_row_number(
    df: DataFrame, value: str, key: str, out: str, descending: bool = False
) -> DataFrame:
    """Row number over the whole table by (value, key); key must be unique."""
    rows = in_ranges(df, _order(value, key, descending))
    offsets = F.broadcast(_by_range(rows).select("__range", "__offset"))
    return rows.join(offsets, "__range").select(
        *df.columns, (F.col("__offset") + F.col("__place") + 1).alias(out)
    )


def global_ntile(
    df: DataFrame, value: str, key: str, tiles: int, out: str, descending: bool = False
) -> DataFrame:
    """NTILE(tiles) over the whole table by (value, key); key must be unique.

    With r rows left over after equal division, the first r tiles hold one more."""
    rows = in_ranges(df, _order(value, key, descending))
    offsets = F.broadcast(_by_range(rows).select("__range", "__offset", "__total"))
    place = F.col("__offset") + F.col("__place")
    size = F.expr(f"__total div {tiles}")
    larger = F.col("__total") % tiles
    in_larger = larger * (size + 1)
    tile = F.when(place < in_larger, F.floor(place / (size + 1))).otherwise(
        larger + F.floor((place - in_larger) / F.greatest(size, F.lit(1)))
    )
    return rows.join(offsets, "__range").select(*df.columns, (tile + 1).cast("int").alias(out))


def global_rank(
    df: DataFrame, value: str, key: str, out: str, descending: bool = True
) -> DataFrame:
    """RANK over the whole table by value: equal values share the lowest number."""
    rows = in_ranges(df, _order(value, key, descending))
    # Few values make a small table of ties, and rows need no shuffle to meet it; many
    # values spread evenly.
    ties = rows.groupBy(F.col("__range").alias("__of"), F.col(value).alias("__tied")).agg(
        F.min("__place").alias("__tie_place")
    )
    rows = rows.join(
        ties, (F.col("__range") == F.col("__of")) & F.col(value).eqNullSafe(F.col("__tied"))
    ).drop("__of", "__tied")
    summary = _by_range(
        rows,
        F.min_by(value, "__place").alias("__first"),
        F.max_by(value, "__place").alias("__last"),
        F.max("__tie_place").alias("__last_tie"),
    )
    # Equal values may continue over the edge of a range.  They take the place where
    # their first range began to hold them.
    chain = W.orderBy("__range")
    summary = (
        summary.withColumn(
            "__last_start",
            F.min(F.col("__offset") + F.col("__last_tie")).over(W.partitionBy("__last")),
        )
        .withColumn("__previous", F.lag("__last").over(chain))
        .withColumn("__previous_start", F.lag("__last_start").over(chain))
        .select(
            "__range",
            "__offset",
            F.when(
                F.col("__previous").eqNullSafe(F.col("__first")), F.col("__previous_start")
            ).alias("__carried"),
        )
    )
    start = F.when(F.col("__tie_place") == 0, F.col("__carried"))
    place = F.coalesce(start, F.col("__offset") + F.col("__tie_place"))
    return rows.join(F.broadcast(summary), "__range").select(
        *df.columns, (place + 1).cast("bigint").alias(out)
    )


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per key in the given order, which must be total within a key.

    Spark limits each key to one row before the shuffle as well as after it, so a hot
    key costs one row per map task."""
    ranked = df.withColumn("__pick", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("__pick") == 1).drop("__pick")
