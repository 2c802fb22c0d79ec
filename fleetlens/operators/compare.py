"""Comparing generated result sets with the truth, many pairs in one job.

Verdicts: 1.0 when every truth row is found, 0.5 when more than half are, else 0.0.
Extra generated rows and columns cost nothing.  Columns are paired by name, so order
and a few known prefixes do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions.numbers import half_even_2
from fleetlens.functions.text import canonical_name, strip
from fleetlens.operators.tolerant import tolerant_match_counts
from fleetlens.sources.checkpoints import written_table
from fleetlens.sources.results import GENERATED, TRUTH

PAIR = ["model", "query_id"]


def normalised(rows: DataFrame) -> DataFrame:
    """Numbers to two places, half to even; all else unchanged.  `result_rows` already
    stores them so; rows from elsewhere go through this first."""
    return rows.withColumn(
        "cells",
        F.transform(
            "cells",
            lambda c: F.struct(
                c["kind"].alias("kind"), half_even_2(c["num"]).alias("num"), c["str"].alias("str")
            ),
        ),
    )


def _paired(columns: DataFrame, name: Column) -> DataFrame:
    """Pair columns of equal name, the nth on one side with the nth on the other."""
    nth = W.partitionBy(*PAIR, "side", "match_name").orderBy("position")
    named = columns.withColumn("match_name", name).withColumn("nth", F.row_number().over(nth))
    key = [*PAIR, "match_name", "nth"]
    truth = named.filter(F.col("side") == TRUTH).select(*key, F.col("position").alias("gt_index"))
    generated = named.filter(F.col("side") == GENERATED).select(
        *key, F.col("position").alias("gen_index")
    )
    return truth.join(generated, key).select(*PAIR, "gt_index", "gen_index")


def column_mapping(outcomes: DataFrame, canonical: bool = True) -> DataFrame:
    """model, query_id, gt_index, gen_index.

    First pass: names equal in any case.  Second pass, for the columns left over: names
    equal once a known prefix is removed.  Training compares exact names only, trimmed.
    """
    columns = outcomes.select(*PAIR, "side", F.posexplode("columns").alias("position", "name"))
    lowered = F.lower("name") if canonical else strip(F.lower("name"))
    exact = _paired(columns, lowered)
    if not canonical:
        return exact
    taken = exact.select(
        *PAIR,
        F.explode(
            F.array(
                F.struct(F.lit(TRUTH).alias("side"), F.col("gt_index").alias("position")),
                F.struct(F.lit(GENERATED).alias("side"), F.col("gen_index").alias("position")),
            )
        ).alias("t"),
    ).select(*PAIR, "t.side", "t.position")
    left = columns.join(taken, [*PAIR, "side", "position"], "left_anti")
    return exact.unionByName(_paired(left, canonical_name(F.col("name"))))


def _bag_counts(rows: DataFrame, *cells: str) -> DataFrame:
    """Distinct rows with their number on each side; duplicates fold on the map side."""
    return rows.groupBy(*PAIR, *cells).agg(
        F.count_if(F.col("side") == TRUTH).alias("gt_n"),
        F.count_if(F.col("side") == GENERATED).alias("gen_n"),
    )


def _bag_sums(*cells: str) -> list[Column]:
    """Rows of each side, and whether their bags may be equal: signed sums of two row hashes.

    Equal rows hash alike, so a sum other than 0 proves the bags unequal.  The sums fold on the
    map side, and of each row only a hash is looked at; no cells are shuffled.  24 bits of
    a hash keep a sum within a long for 10^11 rows."""
    sign = F.when(F.col("side") == TRUTH, 1).otherwise(-1)

    def surplus(seed: int) -> Column:
        return F.sum(sign * F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cells), 40))

    gt_rows, gen_rows = (F.count_if(F.col("side") == side) for side in (TRUTH, GENERATED))
    return [
        gt_rows.alias("gt_rows"),
        gen_rows.alias("gen_rows"),
        ((gt_rows == gen_rows) & (surplus(0) == 0) & (surplus(1) == 0)).alias("may_be_equal"),
    ]


def _equal_bags(rows: DataFrame, sums: DataFrame, *cells: str) -> DataFrame:
    """The pairs whose two bags are equal.  Only those that the sums leave open are grouped by
    their cells; a join shuffled by pair would leave all rows of a pair to one task."""
    open_pairs = sums.filter("may_be_equal AND gt_rows > 0").select(*PAIR)
    return (
        _bag_counts(rows.join(F.broadcast(open_pairs), PAIR, "left_semi"), *cells)
        .groupBy(*PAIR)
        .agg(F.bool_and(F.col("gt_n") == F.col("gen_n")).alias("equal"))
        .filter("equal")
        .select(*PAIR)
    )


def bags_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row, one column `equal`: do two results hold the same rows as bags?"""
    names = [f"c{i}" for i in range(len(left.columns))]
    both = left.toDF(*names).withColumn("__left", F.lit(1)).unionByName(
        right.toDF(*names).withColumn("__left", F.lit(-1))
    )
    surplus = both.groupBy(*names).agg(F.sum("__left").alias("surplus"))
    return surplus.agg((F.count_if(F.col("surplus") != 0) == 0).alias("equal"))


def verdict(matched: Column, total: Column) -> Column:
    return (
        F.when(matched == total, 1.0)
        .when(matched.cast("double") / F.nullif(total, F.lit(0)) > 0.5, 0.5)
        .otherwise(0.0)
    )


def score_pairs(outcomes: DataFrame, rows: DataFrame, training: bool = False) -> DataFrame:
    """Score every (model, query) of `outcomes` from the stored rows of both sides.

    Returns model, query_id, execution_success, execution_error, gt_error, gt_rows,
    gen_rows, mapped_columns, matched, result_match.  A generated query that failed
    scores 0.0; a truth query that failed leaves the verdict null.  In training mode
    names match exactly, rows by membership in the set of generated rows, and there is
    no tolerance.
    """
    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    ran = outcomes.groupBy(*PAIR).agg(
        of(TRUTH, "ok").alias("gt_ok"),
        of(TRUTH, "error").alias("gt_error"),
        of(GENERATED, "ok").alias("gen_ok"),
        of(GENERATED, "error").alias("gen_error"),
    )
    # One row per pair; written, because each later step asks which pairs are open.
    sums = written_table(rows.groupBy(*PAIR).agg(*_bag_sums("cells")))
    found = _equal_bags(rows, sums, "cells").withColumn("whole_equal", F.lit(True))
    whole = written_table(sums.drop("may_be_equal").join(found, PAIR, "left"))
    # A few column indexes per pair.
    mapping = (
        column_mapping(outcomes, canonical=not training)
        .groupBy(*PAIR)
        .agg(F.array_sort(F.collect_list(F.struct("gt_index", "gen_index"))).alias("mapping"))
    )
    undecided = whole.filter("gt_rows > 0 AND gen_rows > 0 AND whole_equal IS NULL").select(*PAIR)
    # One row per pair, so its size is that of the outcomes, which the driver has held.  Spark
    # cannot tell, and rows shuffled by pair would all be grouped in one task per pair.
    asked = F.broadcast(mapping.join(undecided, PAIR, "left_semi"))
    projected = _matchable(rows.join(asked, PAIR), training)
    compared = ("signature", "numbers")
    if training:  # membership needs all rows grouped, which tells equal bags too
        exact = (
            _bag_counts(projected, *compared)
            .groupBy(*PAIR)
            .agg(
                F.bool_and(F.col("gt_n") == F.col("gen_n")).alias("mapped_equal"),
                F.sum(F.when(F.col("gen_n") > 0, F.col("gt_n")).otherwise(0)).alias("close"),
            )
        )
    else:
        projected = written_table(projected)
        sums = written_table(projected.groupBy(*PAIR).agg(*_bag_sums(*compared)))
        found = _equal_bags(projected, sums, *compared)
        exact = written_table(found.withColumn("mapped_equal", F.lit(True)))
    scored = (
        ran.join(whole, PAIR, "left")
        .join(mapping, PAIR, "left")
        .join(exact, PAIR, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("gt_rows", "gen_rows")})
    )
    if not training:
        near = projected.join(exact, PAIR, "left_anti")
        counts = tolerant_match_counts(near.withColumn("pair", F.struct(*PAIR)))
        scored = scored.join(counts.select("pair.*", F.col("matched").alias("close")), PAIR, "left")

    same = F.coalesce("whole_equal", F.lit(False)) | F.coalesce("mapped_equal", F.lit(False))
    matched = F.when(same, F.col("gt_rows")).otherwise(F.coalesce("close", F.lit(0)))
    # Training never grants 1.0 by membership alone: only equal bags do.
    by_rows = verdict(F.col("matched"), F.col("gt_rows"))
    if training:
        by_rows = F.when(same, 1.0).otherwise(F.least(by_rows, F.lit(0.5)))
    return scored.withColumn("matched", matched).select(
        *PAIR,
        F.coalesce("gen_ok", F.lit(False)).alias("execution_success"),
        F.col("gen_error").alias("execution_error"),
        "gt_error",
        "gt_rows",
        "gen_rows",
        F.coalesce(F.size("mapping"), F.lit(0)).alias("mapped_columns"),
        "matched",
        F.when(~F.coalesce("gt_ok", F.lit(False)), F.lit(None).cast("double"))
        .when(~F.coalesce("gen_ok", F.lit(False)), 0.0)
        .when(F.col("gt_rows") == 0, F.when(F.col("gen_rows") == 0, 1.0).otherwise(0.0))
        .otherwise(by_rows)
        .alias("result_match"),
    )


def _matchable(rows: DataFrame, exact: bool) -> DataFrame:
    """Mapped cells of both sides, aligned, in the form tolerant matching takes.

    Rows may match only if their kinds and all their texts agree, which the signature
    stands for; the numbers follow in order.  If numbers are compared exactly, the digits
    that a double does not hold belong to the signature."""

    def side_index(m: Column) -> Column:
        return F.when(F.col("side") == TRUTH, m["gt_index"]).otherwise(m["gen_index"])

    aligned = rows.withColumn(
        "cells", F.transform("mapping", lambda m: F.element_at("cells", side_index(m) + 1))
    )
    # A text is led by its length, which no kind can be taken for.
    fixed = F.array_join(
        F.transform(
            "cells",
            lambda c: F.when(F.lit(not exact) & (c["kind"] == "num"), c["kind"]).otherwise(
                F.coalesce(F.concat(F.length(c["str"]), F.lit(":"), c["str"]), c["kind"])
            ),
        ),
        ",",
    )
    numeric = F.filter("cells", lambda c: c["kind"] == "num")
    # A text shorter than a digest stands for itself.
    digest = F.unhex(F.sha2("fixed", 256))
    signature = F.when(F.octet_length("fixed") < 32, F.col("fixed").cast("binary")).otherwise(digest)
    return aligned.withColumn("fixed", fixed).select(
        *PAIR,
        "side",
        "row_no",
        signature.alias("signature"),
        F.array_join(F.col("cells")["kind"], ",").alias("pattern"),
        numeric["num"].alias("numbers"),
    )
