"""Mixing sources to target weights by capped water-filling.

Each source asks for weight x level words.  A source that would need more than max_epochs
passes over its own words is clamped there, and the level rises until the unclamped
sources have taken up the excess.  Sorted by the level at which a source is clamped, the
clamped ones are a prefix, so the level comes from running sums over the sources.

A source's target is whole passes over all its documents plus a part of one more pass.
The part goes to documents in the order of a seeded hash of id and text, up to the place
where the words taken are nearest to the target.  That place is found by two levels of
sums over 4,096 hash ranges each, so no task sorts a source, however large.

Defined results: null text counts 0 words and is taken 0 times in words; a null source is
a source of its own, weighted last; rows equal in id and text are taken alike (each row
counts); a null id is hashed by its text alone; an empty table gives no rows; only the
named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.columns import hex_number, whole, word_count
from fleetlens.sources.checkpoints import written_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
_RANGES = 4096  # three hex digits


def sampling_place(key: str, text: str, seed: str) -> Column:
    """A row's seeded place on a line of 4,096 x 4,096 positions."""
    said = F.concat(
        F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), whole(text)
    )
    return hex_number(F.substring(F.md5(said.cast("binary")), 1, 6))


def water_fill(
    sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: float
) -> DataFrame:
    """(source, source_size) with the target of each; one row per source throughout.

    The windows run over one row per source, not over documents."""
    by_name = W.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(
        F.array(*map(F.lit, weights)),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    weighed = sizes.select(
        "*",
        weight.cast("double").alias("__weight"),
        (F.col("source_size") * float(max_epochs)).alias("__cap"),
    )
    everything = W.partitionBy(F.lit(1))
    by_clamp = W.orderBy(F.col("__cap") / F.col("__weight"), F.asc_nulls_last("source"))
    before = by_clamp.rowsBetween(W.unboundedPreceding, -1)
    levels = weighed.select(
        "*",
        (
            F.sum("source_size").over(everything) * float(share)
            - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
        ).alias("__left"),
        (
            F.sum("__weight").over(everything)
            - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
        ).alias("__open"),
        F.row_number().over(by_clamp).alias("__order"),
    )
    fits = F.col("__left") * F.col("__weight") <= F.col("__cap") * F.col("__open")
    first = F.min(F.when(fits, F.struct("__order", "__left", "__open"))).over(everything)
    return levels.withColumn("__first", first).select(
        "source",
        "source_size",
        F.when(
            F.col("__order") >= F.col("__first.__order"),
            F.col("__weight") * F.col("__first.__left") / F.col("__first.__open"),
        )
        .otherwise(F.col("__cap"))
        .alias("target"),
    )


def plan_mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per source: source_size, target, whole passes, and the place below which a
    document is taken once more (`limit`)."""
    places = written_table(
        docs.select(
            F.col(source).alias("source"),
            word_count(text).alias("size"),
            sampling_place(key, text, seed).alias("place"),
        )
    )
    targets = written_table(
        water_fill(
            places.groupBy("source").agg(F.sum("size").alias("source_size")),
            weights,
            share,
            max_epochs,
        )
        .withColumn(
            "passes",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
            .otherwise(0)
            .cast("long"),
        )
        .withColumn("extra", F.col("target") - F.col("passes") * F.col("source_size"))
    )

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["source"].eqNullSafe(b["source"])

    # The range of places in which the running sum of words passes `extra`.
    upper = F.floor(F.col("place") / _RANGES)
    ranges = places.groupBy("source", upper.alias("upper")).agg(F.sum("size").alias("n"))
    by_place = W.partitionBy("source").orderBy("upper")
    ranges = ranges.withColumn("before", F.sum("n").over(by_place) - F.col("n"))
    cut = ranges.join(targets, same(ranges, targets)).filter(
        (F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("n"))
    )
    cut = written_table(cut.select(ranges["source"], "upper", "before", "extra"))
    # Inside that range, the place where the sum comes nearest.
    inner = places.join(
        cut, same(places, cut) & (F.floor(places["place"] / _RANGES) == cut["upper"])
    ).select(places["source"], "place", "size", "before", "extra")
    steps = inner.groupBy("source", "before", "extra", "place").agg(F.sum("size").alias("n"))
    running = F.col("before") + F.sum("n").over(W.partitionBy("source").orderBy("place"))
    ends = steps.select("source", "extra", running.alias("sum"), (F.col("place") + 1).alias("limit"))
    starts = cut.select(
        "source", "extra", F.col("before").alias("sum"), (F.col("upper") * _RANGES).alias("limit")
    )
    nearest = (
        ends.unionByName(starts)
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("sum") - F.col("extra")), "sum", "limit")).alias("best"))
    )
    return written_table(
        targets.alias("targets").join(nearest, same(targets, nearest), "left").select(
            targets["source"],
            "source_size",
            "target",
            "passes",
            # Without a part pass no place is low enough, that of a wordless document neither.
            F.when(F.col("targets.extra") > 0, F.coalesce("best.limit", F.lit(0)))
            .otherwise(0)
            .cast("long")
            .alias("limit"),
        )
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """Every row as `row` (a struct of its columns) with size, source_size, target and how
    many `times` the mix takes it."""
    plan = plan_mix(docs, key, text, source, weights, share, max_epochs, seed)
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(source).alias("__source"),
        word_count(text).alias("size"),
        sampling_place(key, text, seed).alias("__place"),
    )
    # The plan has a row per source; a hot source is split by adaptive execution where
    # the plan is too large to be broadcast.
    return rows.join(plan, rows["__source"].eqNullSafe(plan["source"]), "left").select(
        "row",
        "size",
        "source_size",
        "target",
        (F.col("passes") + (F.col("__place") < F.col("limit")).cast("long")).alias("times"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns."""
    taken = mix(docs, **options).filter(F.col("times") > 0)
    return taken.select(
        "row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("__turn")
    ).select("row.*")
