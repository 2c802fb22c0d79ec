"""Stored tables: typed read, typed write, empty creation."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.model import SCHEMAS, Tables

#: The table that no report reads.
OPTIONAL = "quote_lines"


def read_tables(spark: SparkSession, directory: str, optional: bool = True) -> Tables:
    """The Parquet tables of a directory with their declared schemas.

    A table is opened when it is first used.  The optional one is left out if it is absent,
    or unasked for."""

    def opened(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}")

    tables: dict[str, DataFrame | Callable[[], DataFrame]] = {n: opened(n) for n in SCHEMAS}
    if not optional:
        del tables[OPTIONAL]
        return Tables(tables)
    try:
        tables[OPTIONAL] = opened(OPTIONAL)()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        del tables[OPTIONAL]
    return Tables(tables)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast to the declared columns of a table."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[table].fields
        ]
    )


def write_tables(
    tables: Tables | Mapping[str, DataFrame], directory: str, mode: str = "error"
) -> None:
    """Write each table as Parquet.  Files are laid out by the writing tasks, without
    an extra shuffle; pass mode='overwrite' to replace a directory knowingly."""
    for name, df in tables.items():
        conform(df, name).write.mode(mode).parquet(f"{directory}/{name}")


def create_empty_tables(spark: SparkSession, directory: str) -> None:
    empty = {
        name: spark.createDataFrame([], T.StructType(schema.fields))
        for name, schema in SCHEMAS.items()
    }
    write_tables(empty, directory)
