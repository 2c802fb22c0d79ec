"""Merkle manifest of a dataset as a content-addressed store of nodes.

A row is a leaf: the SHA-256 of its fields, each with its length.  The leaves of a group, in
key order, are joined by runs of `FAN_OUT` under the digest of their digests, level by level,
until one is left, the group's subroot; the subroots in group order are joined likewise to
the root.  The store holds one record per distinct inner node: its digest and the digests
of its children.  Equal parts of the data have equal digests and one record.

Requests name leaves by group and rank.  They descend from the root: the next digit of the
rank, base FAN_OUT, selects the child to follow, and the children not selected are collected
as one segment of the path.  Requests that share leading digits share the walk, so a step has
one row per distinct prefix of ranks and is a join with the store by digest.  The segments,
reversed, are the proof: from a leaf's siblings up to the root.  Leaves meet the walks only at
the last step, so what is shuffled of a proof is shared by a run of leaves.

Ranks come from sorted ranges, not from a window over a group, so a group with a third of
all rows is spread like any other.  Each level is written to the shared folder.

Defined results: nulls in fields make leaves like other values; null keys and null groups
come first; rows with equal keys stand in the order of their leaf digests; a repeated row is
a leaf of its own with an equal digest; an empty table gives an empty store, no root and no
proofs; of `with_leaves` only the named columns are read.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.columns import quoted
from fleetlens.operators.ranking import in_ranges
from fleetlens.sources.checkpoints import written_table

FAN_OUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEIGHTS = 21  # FAN_OUT to this power passes any number of rows
_PATH = "array<struct<left:array<binary>,right:array<binary>>>"


class Manifest(NamedTuple):
    """leaves: the given columns with rank; store: part (`group` or `root`), height, digest,
    children; groups: group, rank (among groups), height, digest; tops: the root as a table
    of one row (none without leaves) with group, height, digest."""

    leaves: DataFrame
    store: DataFrame
    groups: DataFrame
    tops: DataFrame


def shown(data: str | Column) -> Column:
    """A digest as lower-case hex text."""
    return F.lower(F.hex(data))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _texts(digests: Column) -> Column:
    return F.array_join(F.transform(digests, shown), "")


def leaf_digest(fields: list[Column]) -> Column:
    """Of the fields in order: `-` if null, else number of UTF-8 bytes, a colon, the value."""
    said = [
        F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-"))
        for f in (field.cast("string") for field in fields)
    ]
    return digest(F.concat(*said))


def with_leaves(
    docs: DataFrame,
    altered: dict[str, Column] | None = None,
    where: Column | None = None,
    key: str = "doc_id",
    group: str = "lang",
    fields: tuple[str, ...] = FIELDS,
) -> DataFrame:
    """key, group (never null: a null group is '', others have '=' before them), leaf, and
    altered_leaf: the leaf with other values for some fields, null where `where` fails."""
    given = [quoted(f) for f in fields]
    changed = [(altered or {}).get(f, quoted(f)) for f in fields]
    other = F.when(F.lit(False) if where is None else where, leaf_digest(changed))
    return docs.select(
        quoted(key).alias("key"),
        F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit("")).alias("group"),
        leaf_digest(given).alias("leaf"),
        other.alias("altered_leaf"),
    )


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with rank (from 0 in their group) and height: the levels above the group's rows."""
    ranges = in_ranges(rows, [F.col("group"), *map(F.col, order)])
    parts = ranges.groupBy("group", "__range").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first")
    )
    # One row per group and range: at most as many per group as there are ranges.
    group = W.partitionBy("group")
    before = F.sum("__n").over(group.orderBy("__range")) - F.col("__n")
    n = F.sum("__n").over(group)
    height = reduce(Column.__add__, [(n > FAN_OUT**k).cast("int") for k in range(_HEIGHTS)])
    starts = parts.select(
        "group", "__range", (before - F.col("__first")).alias("__start"), height.alias("height")
    )
    return ranges.join(starts, ["group", "__range"]).select(
        *rows.columns, (F.col("__start") + F.col("__place")).alias("rank"), "height"
    )


def _levels(nodes: DataFrame, part: str) -> tuple[list[DataFrame], DataFrame]:
    """Records of all inner nodes, and the top of each group (group, height, digest).

    `nodes` are the lowest: group, height of the group, rank, digest."""
    highest = nodes.agg(F.max("height")).first()[0] or 0
    tops, records = [nodes.filter("height = 0")], []
    for level in range(1, highest + 1):
        run = F.expr(f"rank div {FAN_OUT}").alias("rank")
        # A run has FAN_OUT rows at most, whatever the size of its group.
        children = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), "digest")))
        nodes = written_table(
            nodes.filter(F.col("height") >= level)
            .groupBy("group", "height", run)
            .agg(F.transform(children, lambda c: c["digest"]).alias("children"))
            .withColumn("digest", digest(_texts(F.col("children"))))
        )
        records.append(
            nodes.dropDuplicates(["digest"]).select(
                F.lit(part).alias("part"), F.lit(level).alias("height"), "digest", "children"
            )
        )
        tops.append(nodes.filter(F.col("height") == level))
    found = [t.select("group", "height", "digest") for t in tops]
    return records, reduce(DataFrame.unionByName, found)


def build(rows: DataFrame) -> Manifest:
    """The manifest of rows with the columns group, key and leaf, as `with_leaves` gives them."""
    leaves = written_table(_ranked(written_table(rows), ["key", "leaf"]))
    lowest = leaves.select("group", "height", "rank", F.col("leaf").alias("digest"))
    records, tops = _levels(lowest, "group")
    subroots = tops.withColumn("name", F.col("group")).withColumn("group", F.lit(""))
    below = {"subroot_height": F.col("height"), "digest": F.col("digest")}
    ranked = _ranked(
        written_table(subroots.select("group", "name", *(c.alias(n) for n, c in below.items()))),
        ["name"],
    )
    groups = written_table(ranked)
    more, root = _levels(groups.select("group", "height", "rank", "digest"), "root")
    empty = leaves.sparkSession.createDataFrame(
        [], "part string, height int, digest binary, children array<binary>"
    )
    store = written_table(reduce(DataFrame.unionByName, [*records, *more], empty))
    named = groups.select(
        F.col("name").alias("group"), "rank", F.col("subroot_height").alias("height"), "digest"
    )
    return Manifest(leaves, store, named, written_table(root))


def _child(met: DataFrame, rank: Column) -> DataFrame:
    """Walks at the children with these ranks: the others join the path as one segment."""
    place = (rank % FAN_OUT).cast("int")
    segment = F.struct(
        F.slice("children", F.lit(1), place).alias("left"),
        F.slice("children", place + 2, F.lit(FAN_OUT)).alias("right"),
    )
    return met.withColumns(
        {
            "path": F.concat("path", F.array(segment)),
            "digest": F.element_at("children", place + 1),
        }
    )


def _descend(starts: DataFrame, store: DataFrame, leaves: DataFrame) -> DataFrame:
    """`leaves` (group, rank, ...) with the path from their group's top, highest level first.

    `starts` holds the tops asked for: group, height, digest, path so far."""
    run = F.expr(f"rank div {FAN_OUT}")
    runs = written_table(leaves.select("group", run.alias("rank")).distinct())
    highest = starts.agg(F.max("height")).first()[0] or 0
    alone = starts.filter("height = 0").select("group", "path")
    found = [leaves.join(alone, "group")]
    walks = None
    for level in range(highest, 0, -1):
        begin = starts.filter(F.col("height") == level).select(
            "group", F.lit(0).cast("long").alias("rank"), "digest", "path"
        )
        walks = begin if walks is None else walks.unionByName(begin)
        nodes = store.filter(F.col("height") == level).select("digest", "children")
        met = walks.join(nodes, "digest").withColumnRenamed("rank", "above").drop("digest")
        asked = leaves if level == 1 else runs
        if level > 2:
            step = FAN_OUT ** (level - 2)
            asked = runs.select("group", F.expr(f"rank div {step}").alias("rank")).distinct()
        walks = _child(
            asked.withColumn("above", run).join(met, ["group", "above"]), F.col("rank")
        ).drop("above", "children")
    if walks is not None:
        found.append(walks.select(*found[0].columns))
    return reduce(DataFrame.unionByName, found)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """`requests` (group, rank, ...) with `path`: level by level from the leaf up to the root,
    the digests left and right of the way.

    Requests may name any leaves and may repeat."""
    store = manifest.store
    groups = manifest.groups.join(requests.select("group").distinct(), "group", "left_semi")
    starts = manifest.tops.withColumn("path", F.array().cast(_PATH))
    # Written, so that the one group of all groups is a column to join on and no constant.
    named = written_table(
        groups.select(
            F.lit("").alias("group"),
            "rank",
            F.col("group").alias("name"),
            F.col("height").alias("below"),
            F.col("digest").alias("top"),
        )
    )
    reached = _descend(starts, store.filter("part = 'root'"), named)
    inner = written_table(
        reached.select(F.col("name").alias("group"), F.col("below").alias("height"),
                       F.col("top").alias("digest"), "path")
    )
    below = _descend(inner, store.filter("part = 'group'"), requests)
    return below.withColumn("path", F.reverse("path"))


def proof_digest(path: str | Column) -> Column:
    """SHA-256 over the siblings' hex texts, level by level from the leaf, left to right."""
    level = F.transform(path, lambda s: F.concat(_texts(s["left"]), _texts(s["right"])))
    return digest(F.array_join(level, ""))


def folded(leaf: str | Column, path: str | Column) -> Column:
    """The root that a leaf gives with a proof's siblings."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(
        path,
        start,
        lambda now, s: digest(F.concat(_texts(s["left"]), shown(now), _texts(s["right"]))),
    )
