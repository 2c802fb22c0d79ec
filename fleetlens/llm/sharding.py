"""Shards of equal bytes: a minimax contiguous partition of atomic groups.

Documents with equal text are one group and stay together.  Groups are ordered by the
MD5 of their text.  Groups as large as an even share get a shard each; the others are cut
into contiguous runs.  The capacity is the smallest for which filling shards greedily
needs no more shards than there are.  It is searched between the even share and that plus
the largest group, with many trial capacities checked in one pass over the running sums.

Because shards are runs in the order of the group key, a document's shard is a comparison
of its key with at most `shards` cut keys; no join brings it back to the document.

Defined results: null text is empty text (size 1, checksum 0, grouped with the empty); rows
that repeat are rows of one group; a null id is numbered like any other; an empty table
gives no rows; fewer groups than shards leave shards empty; only the named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.columns import whole
from fleetlens.sources.checkpoints import written_table

TRIALS = 48  # capacities checked in one pass


def running_sums(groups: DataFrame) -> DataFrame:
    """(group, bytes) with the sum of bytes up to each group in key order.

    Sums run inside 4,096 ranges of the key, which is an MD5 and so spreads evenly, and are
    chained over one row per range."""
    ranged = groups.withColumn("range", F.substring("group", 1, 3))
    starts = ranged.groupBy("range").agg(F.sum("bytes").alias("n"))
    starts = starts.select(
        F.col("range").alias("__range"),
        (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"),
    )
    inside = F.sum("bytes").over(W.partitionBy("range").orderBy("group"))
    return (
        ranged.withColumn("inside", inside)
        .join(starts, F.col("range") == F.col("__range"))
        .select("group", (F.col("before") + F.col("inside")).alias("sum"))
    )


def _reached(sums: DataFrame, limits: list[int], largest: int) -> list[int]:
    """For each limit the largest running sum within it (0: none).

    A sum no more than the largest group below the limit always exists, so the scan needs
    only the rows around the limits."""
    near = sums.filter((F.col("sum") > min(limits) - largest) & (F.col("sum") <= max(limits)))
    ordered = sorted(set(limits))
    limit = F.array(*map(F.lit, ordered))
    passed = F.size(F.filter(limit, lambda x: x < F.col("sum")))
    found = near.groupBy(passed.alias("passed")).agg(F.max("sum").alias("sum")).collect()
    most = {r["passed"]: r["sum"] for r in found}
    reached, last = {}, 0
    for i, value in enumerate(ordered):
        last = reached[value] = most.get(i, last)
    return [reached[value] for value in limits]


def _ends(sums: DataFrame, capacities: list[int], shards: int, largest: int) -> list[list[int]]:
    """Per capacity the running sum at which each greedy shard but the last ends."""
    at = [0] * len(capacities)
    ends: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards - 1):
        at = _reached(sums, [a + c for a, c in zip(at, capacities, strict=True)], largest)
        for own, a in zip(ends, at, strict=True):
            own.append(a)
    return ends


def smallest_capacity(sums: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list]:
    """The least feasible capacity and the running sums at its cuts."""
    low = max(-(-total // shards), largest)  # nothing below can hold
    high = low + largest  # always enough: each shard but the last is filled to low or more
    best = None
    while best is None or low < high:
        span = high - low
        trials = sorted({low + span * i // (TRIALS - 1) for i in range(TRIALS)})
        ends = _ends(sums, trials, shards, largest)
        for i, (capacity, own) in enumerate(zip(trials, ends, strict=True)):
            if total - (own[-1] if own else 0) <= capacity:
                best, high = own, capacity
                low = trials[i - 1] + 1 if i else capacity
                break
    return high, best


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[str], list[str]]:
    """Keys of the groups with a shard of their own, and the last key of every other shard
    but the last.  Both lists have fewer than `shards` entries."""
    top = groups.orderBy(F.desc("bytes"), "group").limit(shards).collect()
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[str] = []
    for row in top:
        if len(alone) < shards - 1 and row["bytes"] * (shards - len(alone)) >= left:
            alone.append(row["group"])
            left -= row["bytes"]
    others = groups.filter(~F.col("group").isin(alone)) if alone else groups
    largest = max((r["bytes"] for r in top if r["group"] not in alone), default=0)
    if left == 0:
        return alone, []
    sums = written_table(running_sums(others))
    _, ends = smallest_capacity(sums, left, largest, shards - len(alone))
    keys = {r["sum"]: r["group"] for r in sums.filter(F.col("sum").isin(ends)).collect()}
    return alone, [keys[e] for e in ends if e in keys]


def assign_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8
) -> DataFrame:
    """key, size, text_crc32, shard and slot (from 0 without gaps in each shard)."""
    data = whole(text).cast("binary")
    rows = written_table(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(data) + 1).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.md5(data).alias("group"),
        )
    )
    groups = written_table(rows.groupBy("group").agg(F.sum("size").alias("bytes")))
    alone, cuts = cut_keys(groups, shards)
    shard: Column = F.lit(len(alone))
    for last in cuts:
        shard = shard + (F.col("group") > last).cast("int")
    for i, own in enumerate(alone):
        shard = F.when(F.col("group") == own, F.lit(i)).otherwise(shard)
    spread = F.md5(
        F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), "group").cast("binary")
    )
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("spread", spread)
    # Slots run inside 4,096 ranges of a hash of id and text, chained by counts per range.
    placed = placed.withColumn("range", F.substring("spread", 1, 3))
    starts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(
        F.col("shard").alias("__shard"),
        F.col("range").alias("__range"),
        (F.sum("n").over(W.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"),
    )
    inside = F.row_number().over(W.partitionBy("shard", "range").orderBy("spread")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(starts, (F.col("shard") == F.col("__shard")) & (F.col("range") == F.col("__range")))
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            "shard",
            (F.col("before") + F.col("inside")).cast("long").alias("slot"),
        )
    )
