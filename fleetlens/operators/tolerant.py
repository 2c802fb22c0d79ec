"""First-fit one-to-one matching of rows under a relative tolerance.

Each truth row, in order, takes the first generated row that is close to it and not yet
taken; the number of truth rows served is the result.  Two numbers are close when they
differ by at most 2% of the larger magnitude, and of at least 1; everything else has to
be equal.

Rows are cut into blocks that cannot match across, which leaves the outcome unchanged:
first by all cells that must be equal and, where such a block is large, by gaps along
one numeric column.  A block whose rows are all alike needs no matching at all, and
blocks of ordinary size are matched one by one inside tasks.  So are larger ones whose
rows have one number: a tree over the sorted numbers of one side finds the first free
partner of each row of the other side, which pass by in order, so the cost is n log n and a
task holds the smaller side only.  The rule is the same from both sides: a pair is matched
if neither row has an earlier partner.  If that side is too large for a task, a part of it
is held at a time, in order, and what it leaves is asked of the next part.

Any other large block
is cut into ordered chunks on both sides and solved cell by cell: a truth row prefers
any generated row of an earlier chunk to one of a later chunk, so chunk a of the truth
meets chunk p of the generated rows once a has met p - 1 and p has met a - 1.  All cells
with equal a + p are independent and run as one job.  Nothing is sampled, dropped or
capped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.operators.first_fit import (
    FLOOR,
    LINEAR_BIN,
    PACK_ROWS,
    PACKED,
    SERVED,
    TOLERANCE,
    matched_count,
    matched_rows,
    pack_values,
    serve_packed,
)
from fleetlens.operators.numbering import row_number_within
from fleetlens.sources.checkpoints import written_table
from fleetlens.sources.results import GENERATED, TRUTH

# Logarithmic bins above FLOOR, like the linear ones below it, are a little wider than
# the tolerance: close values lie in the same or in neighbouring bins.
_LOG_BIN = 0.0207

BLOCK_LIMIT = 2_000  # rows per side of a block that one call matches
DENSE_LIMIT = 8_000_000  # rows of one number that a task holds, of the smaller side of a block
CHUNK_ROWS = 20_000  # rows per side of a cell of a larger block

_GROUP = ["pair", "signature"]
_BLOCK = [*_GROUP, "component"]


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(FLOOR)) * TOLERANCE


def _span_is_close(low: Column, high: Column) -> Column:
    """Whether numbers from low to high are all within the tolerance of the smallest."""
    smallest = F.when(low * high > 0, F.least(F.abs(low), F.abs(high))).otherwise(0.0)
    return high - low <= F.greatest(smallest, F.lit(FLOOR)) * TOLERANCE


def tolerance_bin(value: Column) -> Column:
    size = F.abs(value)
    steps = F.when(size <= FLOOR, size / LINEAR_BIN).otherwise(
        FLOOR / LINEAR_BIN + F.log(F.greatest(size, F.lit(FLOOR))) / _LOG_BIN
    )
    return F.floor(F.signum(value) * steps)


def _with_components(rows: DataFrame) -> DataFrame:
    """Number the runs of occupied bins along the most selective numeric column."""
    keys = ["pair", "pattern"]
    exploded = rows.select(*keys, F.posexplode("numbers").alias("position", "value"))
    spread = (
        exploded.select(*keys, "position", tolerance_bin(F.col("value")).alias("bin"))
        .distinct()
        .groupBy(*keys, "position")
        .agg(F.count(F.lit(1)).alias("bins"))
    )
    # One row per numeric column of a result.
    best = W.partitionBy(*keys).orderBy(F.desc("bins"), "position")
    chosen = (
        spread.withColumn("place", F.row_number().over(best))
        .filter("place = 1")
        .select(*keys, "position")
    )
    binned = rows.join(chosen, keys).withColumn(
        "bin", tolerance_bin(F.expr("numbers[position]"))
    )
    # Doubles span fewer than 75,000 bins, which bounds each window partition.
    occupied = binned.select("pair", "signature", "bin").distinct()
    along = W.partitionBy("pair", "signature").orderBy("bin")
    runs = occupied.withColumn(
        "starts", F.coalesce(F.col("bin") - F.lag("bin").over(along) > 1, F.lit(True))
    ).withColumn("component", F.sum(F.col("starts").cast("int")).over(along))
    return binned.join(
        runs.select("pair", "signature", "bin", "component"), ["pair", "signature", "bin"]
    ).select(*_BLOCK, "side", "row_no", "numbers")


def _side(rows: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """Rows of one side gathered per key, in order, as flat arrays."""
    gathered = (
        rows.filter(F.col("side") == side)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("row_no", "numbers"))).alias("r"))
    )
    return gathered.select(
        *keys,
        F.transform("r", lambda x: x["row_no"]).alias(f"{side}_no"),
        F.flatten(F.transform("r", lambda x: x["numbers"])).alias(f"{side}_values"),
        (F.size(F.col("r")[0]["numbers"])).alias(f"{side}_width"),
    )


def _sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block with rows on both sides: counts, how many numbers a row has, whether
    it is one finite number, how to solve the block, and what it serves if that needs no
    matching."""
    counts = [
        F.count_if(F.col("side") == TRUTH).alias("gt_n"),
        F.count_if(F.col("side") == GENERATED).alias("gen_n"),
    ]
    # All rows of a block have as many numbers.  One number at most is the common case, and
    # plain doubles can be aggregated by hashing and compared in compiled code, which arrays
    # cannot.
    first, width = F.get("numbers", F.lit(0)), F.size("numbers")
    low, high = F.col("low"), F.col("high")
    narrow = (
        rows.filter(width <= 1)
        .groupBy(*keys)
        .agg(*counts, F.min(first).alias("low"), F.max(first).alias("high"))
        .select(
            *keys,
            "gt_n",
            "gen_n",
            low.isNotNull().cast("int").alias("width"),
            # Rows that are all alike, or all close to each other, match as far as they go.
            (low.isNull() | (low == high) | _span_is_close(low, high)).alias("alike"),
            (low.isNull() | _close(low, high)).alias("close"),
            # NaN is the greatest number.
            (low.isNotNull() & (low > float("-inf")) & (high < float("inf"))).alias("one_number"),
        )
    )
    wide = (
        rows.filter(width > 1)
        .groupBy(*keys)
        .agg(*counts, F.min("numbers").alias("low"), F.max("numbers").alias("high"))
        .select(
            *keys,
            "gt_n",
            "gen_n",
            F.size(low).alias("width"),
            (low == high).alias("alike"),
            F.forall(F.zip_with(low, high, _close), lambda c: c).alias("close"),
            F.lit(False).alias("one_number"),
        )
    )
    # In a block of one row a side, low and high are those two rows.
    largest = F.greatest("gt_n", "gen_n")
    simple = F.col("alike") | (largest == 1)
    served = F.when(F.col("close"), F.least("gt_n", "gen_n")).otherwise(0)
    return written_table(
        narrow.unionByName(wide)
        .filter("gt_n > 0 AND gen_n > 0")
        .withColumns({"simple": simple, "oversize": ~simple & (largest > BLOCK_LIMIT)})
        .withColumn("served", F.when(F.col("simple"), served))
        .drop("alike", "close")
    )


def _at_once(sizes: DataFrame) -> DataFrame:
    return sizes.filter("simple").select("pair", F.col("served").alias("matched"))


def _one_call_each(rows: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    ordinary = sizes.filter("NOT simple AND NOT oversize").select(*keys)
    inside = rows.join(ordinary, keys, "left_semi")
    return (
        _side(inside, TRUTH, keys)
        .join(_side(inside, GENERATED, keys), keys)
        .select("pair", matched_count("gt_values", "gen_values", "gt_width").alias("matched"))
    )


def _small_blocks(rows: DataFrame, sizes: DataFrame, keys: list[str]) -> list[DataFrame]:
    """What all but oversize blocks match.  Where none needs a call, no row is shuffled."""
    parts = [_at_once(sizes)]
    if not sizes.filter("NOT simple AND NOT oversize").isEmpty():
        parts.append(_one_call_each(rows, sizes, keys))
    return parts


def tolerant_match_counts(rows: DataFrame) -> DataFrame:
    """pair, matched: truth rows served by first fit, for every pair with any.

    `rows` has pair (any type), side, row_no, signature (equal for rows that may
    match), pattern (the kinds of cells) and numbers (the numeric cells in order)."""
    sizes = _sizes(rows, _GROUP)
    parts = _small_blocks(rows, sizes, _GROUP)
    large = sizes.filter("oversize").select(*_GROUP)
    if not large.isEmpty():
        blocks = written_table(_with_components(rows.join(large, _GROUP, "left_semi")))
        sizes = _sizes(blocks, _BLOCK)
        parts += _small_blocks(blocks, sizes, _BLOCK)
        oversize = sizes.filter("oversize")
        largest = oversize.groupBy("one_number").agg(
            F.max(F.least("gt_n", "gen_n")).alias("held")
        )
        held = {r["one_number"]: r["held"] for r in largest.collect()}
        if True in held:
            parts.append(_match_one_number(blocks, oversize.filter("one_number"), held[True]))
        if False in held:
            rest = oversize.filter("NOT one_number").select(*_BLOCK)
            parts.append(_match_in_chunks(blocks.join(rest, _BLOCK, "left_semi")))
    return reduce(DataFrame.unionByName, parts).groupBy("pair").agg(
        F.sum("matched").alias("matched")
    )


def _match_one_number(rows: DataFrame, blocks: DataFrame, largest: int) -> DataFrame:
    """Blocks of one finite number, each by one task at a time.

    Rows are put in order and packed by many tasks; the last one of a block gets its values
    as a few long rows.  `largest` is the number of rows of the largest smaller side."""
    asks = F.when(F.col("gt_n") < F.col("gen_n"), F.lit(GENERATED)).otherwise(F.lit(TRUTH))
    numbered = written_table(
        blocks.select(*_BLOCK, asks.alias("asks"), F.monotonically_increasing_id().alias("block_no"))
    )
    order = ["block_no", "asks", "row_no"]
    values = rows.join(numbered, _BLOCK).select(
        "block_no",
        (F.col("side") == F.col("asks")).alias("asks"),
        "row_no",
        F.get("numbers", F.lit(0)).alias("value"),
    )
    packs = (
        values.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(pack_values, PACKED)
    )
    at_once = max(DENSE_LIMIT, PACK_ROWS)
    passes = (largest - 1) // at_once + 1
    if passes == 1:
        found = _served(packs)
    else:
        packs = written_table(packs)
        before = W.partitionBy("block_no").orderBy("first_no").rowsBetween(
            W.unboundedPreceding, -1
        )
        # One row per pack, without its values.
        parts = (
            packs.filter("NOT asks")
            .select("block_no", "first_no", "n")
            .withColumn("part", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / at_once))
            .drop("n")
        )
        held = written_table(packs.filter("NOT asks").join(parts, ["block_no", "first_no"]))
        left, steps = packs.filter("asks"), []
        for part in range(passes):
            now = held.filter(F.col("part") == part).select(*PACKED.names)
            steps.append(written_table(_served(now.unionByName(left))))
            left = steps[-1].filter("n > 0").select(*PACKED.names)
        found = reduce(DataFrame.unionByName, [s.select("block_no", "matched") for s in steps])
    matched = found.groupBy("block_no").agg(F.sum("matched").alias("matched"))
    return numbered.join(matched, "block_no").select("pair", "matched")


def _served(packs: DataFrame) -> DataFrame:
    return (
        packs.repartition("block_no")
        .sortWithinPartitions("block_no", "asks", "first_no")
        .mapInArrow(serve_packed, SERVED)
    )


def _match_in_chunks(rows: DataFrame) -> DataFrame:
    """Exact matching of oversize blocks, one job per diagonal of chunk pairs."""
    side_block = ["side", *_BLOCK]
    left = row_number_within(rows, side_block, "row_no", "place").withColumn(
        "chunk", F.floor(F.col("place") / CHUNK_ROWS)
    )
    left = written_table(left.drop("place"))
    last = left.groupBy("side").agg(F.max("chunk").alias("chunk")).collect()  # two rows
    diagonals = sum(row["chunk"] for row in last) + 1
    cell = [*_BLOCK, "truth_chunk"]
    found = []
    for diagonal in range(diagonals):
        truth = left.filter(F.col("side") == TRUTH).withColumn("truth_chunk", F.col("chunk"))
        generated = left.filter(F.col("side") == GENERATED).withColumn(
            "truth_chunk", F.lit(diagonal) - F.col("chunk")
        )
        in_range = (F.col("truth_chunk") >= 0) & (F.col("truth_chunk") <= diagonal)
        matches = (
            _side(truth.filter(in_range), TRUTH, cell)
            .join(_side(generated.filter(in_range), GENERATED, cell), cell)
            .select(
                *_BLOCK,
                F.explode(
                    matched_rows("gt_no", "gt_values", "gen_no", "gen_values", "gt_width")
                ).alias("m"),
            )
        )
        matches = written_table(matches)
        found.append(matches.groupBy("pair").agg(F.count(F.lit(1)).alias("matched")))
        taken = matches.select(
            *_BLOCK,
            F.explode(
                F.array(
                    F.struct(F.lit(TRUTH).alias("side"), F.col("m.truth_row").alias("row_no")),
                    F.struct(
                        F.lit(GENERATED).alias("side"), F.col("m.generated_row").alias("row_no")
                    ),
                )
            ).alias("t"),
        ).select(*_BLOCK, "t.side", "t.row_no")
        left = written_table(left.join(taken, [*side_block, "row_no"], "left_anti"))
    return reduce(DataFrame.unionByName, found)
