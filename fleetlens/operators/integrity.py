"""Constraint checks.  Each returns one row per constraint: table, check, column, bad."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.model import (
    ALLOWED_VALUES,
    DERIVED_TOTALS,
    FOREIGN_KEYS,
    SCHEMAS,
    UNIQUE_KEYS,
    Tables,
)

TOTAL_TOLERANCE = 0.005


def _named(df: DataFrame, table: str, check: str, column: str) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(check).alias("check_name"),
        F.lit(column).alias("column_name"),
        F.col("bad").cast("bigint").alias("bad"),
    )


def _per_column(df: DataFrame, table: str, check: str, bad_if: dict) -> DataFrame:
    """Several counts over one table in a single pass."""
    counts = df.agg(*[F.count_if(condition).alias(c) for c, condition in bad_if.items()])
    long = counts.unpivot([], list(bad_if), "column_name", "bad")
    return long.select(
        F.lit(table).alias("table_name"),
        F.lit(check).alias("check_name"),
        "column_name",
        F.col("bad").cast("bigint").alias("bad"),
    )


def null_violations(df: DataFrame, table: str) -> DataFrame:
    required = [f.name for f in SCHEMAS[table].fields if not f.nullable]
    return _per_column(df, table, "not_null", {c: F.col(c).isNull() for c in required})


def value_violations(df: DataFrame, table: str) -> DataFrame | None:
    closed = {c: v for (t, c), v in ALLOWED_VALUES.items() if t == table}
    if not closed:
        return None
    return _per_column(
        df, table, "allowed_values", {c: ~F.col(c).isin(*v) for c, v in closed.items()}
    )


def duplicate_keys(df: DataFrame, table: str, *columns: str) -> DataFrame:
    """Number of key values that occur more than once; nulls do not count."""
    present = df.dropna(subset=list(columns))
    repeated = present.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _named(
        repeated.agg(F.count(F.lit(1)).alias("bad")), table, "unique", ",".join(columns)
    )


def orphan_keys(t: Tables, keys: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows whose non-null key has no parent, for all (child, column, parent) at once.

    A table is read once for all keys that it holds, and once if it is a parent.  Keys are
    counted before they meet the parents, so one held by very many rows meets them once."""
    number = {name: i for i, name in enumerate(dict.fromkeys(parent for _, _, parent in keys))}
    held = []
    for child in dict.fromkeys(child for child, _, _ in keys):
        of_child = [
            F.struct(
                F.lit(n).alias("n"), F.lit(number[parent]).alias("parent"),
                F.col(column).cast("bigint").alias("key"),
            )
            for n, (name, column, parent) in enumerate(keys)
            if name == child
        ]
        held.append(getattr(t, child).select(F.inline(F.array(*of_child))))
    counted = (
        reduce(DataFrame.unionByName, held)
        .filter(F.col("key").isNotNull())
        .groupBy("n", "parent", "key")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    parents = [
        getattr(t, name).select(F.lit(i).alias("parent"), F.col("id").cast("bigint").alias("key"))
        for name, i in number.items()
    ]
    # An anti join would be pushed below the union and read every parent for every child.
    known = reduce(DataFrame.unionByName, parents).withColumn("known", F.lit(True))
    orphans = counted.join(known, ["parent", "key"], "left").filter(F.col("known").isNull())
    found = orphans.groupBy("n").agg(F.sum("rows").alias("bad"))
    declared = orphans.sparkSession.createDataFrame(
        [(n, child, column) for n, (child, column, _) in enumerate(keys)],
        "n int, table_name string, column_name string",
    )
    return declared.join(found, "n", "left").select(
        "table_name",
        F.lit("foreign_key").alias("check_name"),
        "column_name",
        F.coalesce("bad", F.lit(0)).cast("bigint").alias("bad"),
    )


def total_violations(
    headers: DataFrame, lines: DataFrame, table: str, line_key: str, amount: str, total: str
) -> DataFrame:
    """Headers whose total is not the sum of their lines."""
    sums = lines.groupBy(F.col(line_key).alias("header_id")).agg(
        F.sum(F.expr(amount)).alias("line_sum")
    )
    gap = F.abs(F.col(total) - F.coalesce("line_sum", F.lit(0.0)))
    checked = headers.select("id", total).join(sums, F.expr("id = header_id"), "left")
    return _named(
        checked.agg(F.count_if(gap > TOTAL_TOLERANCE).alias("bad")), table, "derived_total", total
    )


CHECKS = ("not_null", "allowed_values", "unique", "foreign_key", "derived_total")


def all_violations(t: Tables, kinds: Sequence[str] = CHECKS) -> DataFrame:
    """Every declared constraint of the given kinds on the tables at hand."""
    have = set(t.names())
    checks: list[DataFrame | None] = []
    if "not_null" in kinds:
        checks += [null_violations(df, name) for name, df in t.items()]
    if "allowed_values" in kinds:
        checks += [value_violations(df, name) for name, df in t.items()]
    if "unique" in kinds:
        checks += [
            duplicate_keys(getattr(t, name), name, column)
            for name, column in UNIQUE_KEYS
            if name in have
        ]
    if "foreign_key" in kinds:
        keys = [k for k in FOREIGN_KEYS if k[0] in have and k[2] in have]
        checks += [orphan_keys(t, keys)] if keys else []
    if "derived_total" in kinds:
        checks += [
            total_violations(getattr(t, header), getattr(t, lines), header, key, amount, total)
            for header, lines, key, amount, total in DERIVED_TOTALS
            if header in have and lines in have
        ]
    return reduce(DataFrame.unionByName, [c for c in checks if c is not None])
