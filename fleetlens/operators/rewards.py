"""Rewards for sampled completions, one column each, and their group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import extract_sql, starts_with_select

# What a completion earns for its form and for running at all.
FORMAT_REWARD = 0.25
EXECUTION_REWARD = 0.5

SAMPLE = ["prompt_id", "sample_no"]


def with_format_reward(completions: DataFrame) -> DataFrame:
    """Adds the extracted sql and format_reward; `completions` has text."""
    return completions.withColumn("sql", extract_sql(F.col("text"))).withColumn(
        "format_reward", F.when(starts_with_select(F.col("sql")), FORMAT_REWARD).otherwise(0.0)
    )


def _key(sql: str) -> Column:
    """Whole texts meet by their SHA-256, so that joins shuffle and sort narrow keys."""
    return F.sha2(F.col(sql), 256)


def with_execution_reward(completions: DataFrame, executions: DataFrame) -> DataFrame:
    """`executions` has one row per distinct sql: sql, ok."""
    # A third of all completions may share one text; its outcome is one row.
    ran = executions.select(_key("sql").alias("ran_key"), F.col("ok"))
    earned = F.when((F.col("sql") != "") & F.col("ok"), EXECUTION_REWARD).otherwise(0.0)
    return (
        completions.withColumn("sql_key", _key("sql"))
        .join(ran, F.expr("sql_key = ran_key"), "left")
        .withColumn("execution_reward", earned)
        .drop("sql_key", "ran_key", "ok")
    )


def with_correctness_reward(completions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`verdicts` has one row per (prompt_id, sql): prompt_id, sql, result_match.  What
    is missing or null, because either side failed, earns nothing."""
    known = verdicts.select(
        F.col("prompt_id").alias("v_prompt"),
        _key("sql").alias("v_key"),
        F.col("result_match"),
    )
    earned = F.when(F.col("sql") != "", F.coalesce("result_match", F.lit(0.0))).otherwise(0.0)
    return (
        completions.withColumn("sql_key", _key("sql"))
        .join(known, F.expr("prompt_id = v_prompt AND sql_key = v_key"), "left")
        .withColumn("correctness_reward", earned)
        .drop("sql_key", "v_prompt", "v_key", "result_match")
    )


def with_total_reward(completions: DataFrame) -> DataFrame:
    return completions.withColumn(
        "reward",
        F.col("format_reward") + F.col("execution_reward") + F.col("correctness_reward"),
    )


def group_statistics(completions: DataFrame) -> DataFrame:
    """Per prompt: samples, mean, spread, least and greatest reward."""
    return completions.groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("reward").alias("mean_reward"),
        F.stddev_samp("reward").alias("std_reward"),
        F.min("reward").alias("min_reward"),
        F.max("reward").alias("max_reward"),
    )
