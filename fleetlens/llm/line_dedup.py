"""Removing boilerplate lines by the number of distinct sites they stand on.

A line is keyed by a hash of its trimmed text.  HyperLogLog sketches of the sites merge by
aggregation, so a line on a third of all pages costs one sketch per map task.  Estimates
well above or below the limit decide at once; lines whose estimate is near it are counted
exactly.  A boilerplate line stays at its first place (smallest id, then position) and is
removed everywhere else.  Only DataFrame functions run.

The key is 64 bits wide.  Two different lines with one key would add up their sites, which
matters only if the sum reaches the limit; among a trillion lines some ten thousand pairs
share a key, so this is accepted.

Defined results: null text stays null and has 0 lines; an empty text has one empty line;
lines shorter than min_chars after trimming of spaces are never boilerplate; null sites
count as one site; null ids come last when the first place is sought; rows equal in id and
text are treated alike; an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.columns import word_count
from fleetlens.sources.checkpoints import written_table

#: Sites from which a line is boilerplate unless told otherwise: lines of many words hardly
#: recur by chance, shorter ones need more sites.
LONG_SITES, SHORT_SITES = 3, 5
LONG_WORDS = 8
MIN_CHARS = 20
SKETCH_BITS = 12  # standard error 1.04 / sqrt(2^12) = 1.6 %
NEAR = 0.065  # four standard errors


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _keyed_lines(
    docs: DataFrame, key: str, text: str, site: str, min_chars: int, graded: bool
) -> DataFrame:
    """One row per line that is long enough: key, site, place, its row's two keys, and if
    graded the sites from which it is boilerplate."""
    lines = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"),
        *_row_keys(key, text),
        F.posexplode(_lines(text)).alias("pos", "line"),
    ).filter(F.char_length(F.trim("line")) >= min_chars)
    return lines.select(
        _key(F.col("line")).alias("line"),
        "site",
        F.struct(F.col("id").isNull().alias("unknown"), "id", "pos").alias("place"),
        "row_a",
        "row_b",
        *([_limit(F.col("line")).alias("limit")] if graded else []),
    )


def _limit(line: Column) -> Column:
    return F.when(word_count(line) >= LONG_WORDS, LONG_SITES).otherwise(SHORT_SITES)


def _row_keys(key: str, text: str) -> list[Column]:
    return [
        F.xxhash64(F.lit(0), key, text).alias("row_a"),
        F.xxhash64(F.lit(1), text, key).alias("row_b"),
    ]


def boilerplate_lines(lines: DataFrame, min_sites: int | None) -> DataFrame:
    """(line, place): keys of lines on at least min_sites sites, or their own limit if that is
    None, with their first place."""
    graded = min_sites is None
    limit = F.col("limit") if graded else F.lit(min_sites)
    margin = max(1.0, NEAR * (SHORT_SITES if graded else min_sites))
    spread = written_table(
        lines.groupBy("line")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"),
            F.min("place").alias("place"),
            *([F.max("limit").alias("limit")] if graded else []),
        )
        .filter(F.col("sites") >= limit - margin)
    )
    near = spread.filter(F.col("sites") <= limit + margin)
    counted = (
        lines.join(near.select("line"), "line", "left_semi")
        .groupBy("line", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line")
        .agg(F.count("one").alias("exact"))
    )
    return written_table(
        spread.filter(F.col("sites") > limit + margin)
        .select("line", "place")
        .unionByName(
            near.join(counted, "line").filter(F.col("exact") >= limit).select("line", "place")
        )
    )


def remove_boilerplate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int | None = None,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Every row as `row` (a struct of its columns) with the cleaned `text`, `n_lines` and
    `n_removed`.

    min_sites None: LONG_SITES for lines of LONG_WORDS words and more, SHORT_SITES for others."""
    lines = _keyed_lines(docs, key, text, site, min_chars, min_sites is None)
    known = boilerplate_lines(lines, min_sites).withColumnRenamed("place", "first")
    # Per row the boilerplate keys it holds, and where one of them may stay.
    here = F.col("place.id").eqNullSafe(F.col("first.id"))
    hits = (
        lines.join(known, "line")
        .groupBy("row_a", "row_b")
        .agg(
            F.collect_set(
                F.struct("line", F.when(here, F.col("first.pos")).otherwise(-1).alias("stays"))
            ).alias("hits")
        )
    )
    rows = docs.select(
        F.struct("*").alias("row"), F.col(text).alias("__text"), *_row_keys(key, text)
    )
    found = rows.join(hits, ["row_a", "row_b"], "left").withColumn("__lines", _lines("__text"))
    keys, stays = F.col("hits.line"), F.col("hits.stays")

    def kept(line: Column, pos: Column) -> Column:
        at = F.array_position(keys, _key(line))
        return (at == 0) | (F.element_at(stays, F.greatest(at, F.lit(1)).cast("int")) == pos)

    left = F.when(F.col("hits").isNull(), F.col("__lines")).otherwise(F.filter("__lines", kept))
    return found.select(
        "row", "__lines", left.alias("__left"), F.col("hits").isNull().alias("__whole"), "__text"
    ).select(
        "row",
        F.when(F.col("__whole"), F.col("__text"))
        .otherwise(F.array_join("__left", "\n"))
        .alias("text"),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__lines") - F.size("__left"), F.lit(0)).cast("long").alias("n_removed"),
    )
