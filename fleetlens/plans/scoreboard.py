"""Score rollups over results: one row per (model_name, query_id) with difficulty,
execution_success and result_match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import shorten

DIFFICULTY_ORDER = ("easy", "medium", "hard")


#: Label of a result whose truth failed, so that nothing could be compared.
UNSCORED = "Unscored"


def run_status() -> Column:
    return (
        F.when(F.col("result_match").isNull(), UNSCORED.upper())
        .when(F.col("result_match") == 1.0, "MATCH")
        .when(F.col("result_match") == 0.5, "PARTIAL")
        .when(F.col("execution_success"), "FAIL")
        .otherwise("ERROR")
    )


def detail_status() -> Column:
    return (
        F.when(F.col("result_match").isNull(), UNSCORED)
        .when(F.col("result_match") == 1.0, "Pass")
        .when(F.col("result_match") == 0.5, "Partial")
        .otherwise("Fail")
    )


def model_summary(results: DataFrame) -> DataFrame:
    """Execution accuracy, mean match and passed queries of each model.

    Results without a verdict count among the queries, but not in the mean match."""
    return results.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.round(F.avg(F.col("execution_success").cast("double")), 4).alias("execution_accuracy"),
        F.round(F.avg("result_match"), 4).alias("result_match_avg"),
        F.count_if(F.col("result_match") == 1.0).alias("queries_passed"),
    )


def match_table(results: DataFrame) -> DataFrame:
    """The long table behind the charts."""
    return results.select(
        F.concat(F.lit("Q"), F.col("query_id")).alias("query"),
        F.col("model_name").alias("model"),
        "result_match",
        "difficulty",
    )


def score_by_difficulty(results: DataFrame) -> DataFrame:
    """Mean match per difficulty and model, from easy to hard."""
    rank = F.array_position(F.array(*map(F.lit, DIFFICULTY_ORDER)), F.col("difficulty"))
    return (
        results.groupBy("difficulty", F.col("model_name").alias("model"))
        .agg(F.avg("result_match").alias("mean_match"))
        .orderBy(rank, "model")
    )


def model_comparison(results: DataFrame) -> DataFrame:
    """Mean match per query and model: one row for every pair that occurs."""
    return (
        results.groupBy("query_id", F.col("model_name").alias("model"))
        .agg(F.avg("result_match").alias("mean_match"))
        .orderBy("query_id", "model")
    )


def detail_table(results: DataFrame, question_length: int = 80) -> DataFrame:
    """Per query: status, the question and a short label of it, row counts of both sides."""
    return results.select(
        "model_name",
        "query_id",
        "difficulty",
        detail_status().alias("status"),
        "question",
        shorten(F.col("question"), question_length).alias("question_label"),
        "ground_truth_row_count",
        "generated_row_count",
        "result_match",
    )


def query_results(catalogue: DataFrame, answers: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores joined with questions and texts: one flat row per (model, query)."""
    asked = catalogue.select(
        "query_id", "question", "difficulty", F.col("sql").alias("ground_truth_sql")
    )
    given = answers.select("model", "query_id", F.col("sql").alias("generated_sql"))
    return (
        scores.join(given, ["model", "query_id"])
        .join(asked, "query_id")
        .select(
            F.col("model").alias("model_name"),
            "query_id",
            "question",
            "difficulty",
            "ground_truth_sql",
            "generated_sql",
            "execution_success",
            "execution_error",
            F.col("gt_rows").alias("ground_truth_row_count"),
            F.col("gen_rows").alias("generated_row_count"),
            "result_match",
        )
    )


def benchmark_records(results: DataFrame, timestamp: str) -> DataFrame:
    """One record per model holding its results, ready for the score files.

    A model has one result per catalogue question, which bounds the array."""
    per_query = [c for c in results.columns if c != "model_name"]
    gathered = results.groupBy("model_name").agg(
        F.array_sort(F.collect_list(F.struct(*per_query))).alias("results")
    )
    summary = model_summary(results).drop("queries_passed")
    return summary.join(gathered, "model_name").withColumn("timestamp", F.lit(timestamp))
