"""Connected components of a graph given as a table of links.

Large-star and small-star rounds: every node's links move to its least neighbour until each
component is a star around its least node.  A round is two aggregations and two joins; its
result is written to the shared folder, so a lost executor costs one round at most.  The
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.checkpoints import written_table


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the least of it and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return (
        both.filter(F.col("b") > F.col("a"))
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return (
        moved.filter(F.col("a") != F.col("b"))
        .unionByName(least.withColumnRenamed("least", "b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node with the least node that can be reached.

    `links` has long columns a and b; rows that repeat or link a node to itself do no harm.
    Nodes without links are not in the result."""
    now = written_table(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    seen = None
    while True:
        state = tuple(now.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
        now = written_table(_small_star(_large_star(now)))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
