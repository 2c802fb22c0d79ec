import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("fleetlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """The business tables of the smallest fixture as a folder of stored tables."""
    from fleetlens.sources.binding import bind
    from fleetlens.sources.tables import write_tables

    folder = str(tmp_path_factory.mktemp("business") / "tables")
    write_tables(bind(spark, SMALL), folder)
    return folder


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for path in sorted(Path(SMALL).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def bag(columns, rows):
    """Rows as a sorted list with columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_bag(df):
    return bag(df.columns, [tuple(r) for r in df.collect()])
