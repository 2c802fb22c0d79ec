"""Cutting lineage on storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    A cluster names it in spark.checkpoint.dir.  Only a local-mode session without the
    setting, as in tests, gets a folder of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            named = tempfile.mkdtemp(prefix="fleetlens-checkpoint-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def written_table(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there.

    Unlike a cached or checkpointed DataFrame the table is columnar, so later readers
    prune columns, and Spark knows its true size when it plans a join.  An executor
    lost later costs no recomputation of what led here."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
