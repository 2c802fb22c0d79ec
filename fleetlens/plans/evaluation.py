"""From raw model texts to scores and rewards.

The driver submits each distinct query text once and holds only the texts; what the
queries return is written, compared and rolled up by the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.text import extract_sql
from fleetlens.model import Tables
from fleetlens.operators import rewards
from fleetlens.operators.compare import score_pairs
from fleetlens.plans.catalogue import EVAL, CatalogueQuery, catalogue_table
from fleetlens.plans.reports import EVAL_REPORTS, TRAINING_REPORTS
from fleetlens.plans.scoreboard import query_results
from fleetlens.sources.checkpoints import written_table
from fleetlens.sources.runner import QueryRunner, score_texts

OpenTables = Callable[[SparkSession], Tables]


def report_truth(
    tables: Tables,
    as_of: date,
    split: str = EVAL,
    only: Collection[int] | None = None,
    **parameters: dict,
) -> dict[int, DataFrame]:
    """The reports of a split, all or `only` some, as truth, by query id; parameters go by
    report name."""
    chosen = EVAL_REPORTS if split == EVAL else TRAINING_REPORTS
    return {
        number: report(tables, as_of, **parameters.get(report.__name__, {}))
        for number, report in chosen.items()
        if only is None or number in only
    }


def evaluate_responses(
    spark: SparkSession,
    open_tables: OpenTables,
    entries: Sequence[CatalogueQuery],
    responses: DataFrame,
    truth: Mapping[int, str | DataFrame] | None = None,
) -> DataFrame:
    """Score raw responses (model, query_id, raw) to the given catalogue queries.

    A missing or failed response is a null raw text, and counts as not executed.  The
    truth is the catalogue's SQL unless given; on large tables give `report_truth`,
    whose ranked reports need no window over the whole table."""
    truth = {e.query_id: e.sql for e in entries} if truth is None else truth
    answers = written_table(
        responses.select(
            "model", "query_id", F.coalesce(extract_sql(F.col("raw")), F.lit("")).alias("sql")
        ).withColumn("key", F.sha2("sql", 256))
    )
    # Models that answer a question alike are run and compared once.
    distinct = answers.select("key", "query_id", "sql").distinct()
    runner = QueryRunner(spark, open_tables)
    texts = ((r["key"], r["query_id"], r["sql"]) for r in distinct.toLocalIterator())
    outcomes, rows = score_texts(runner, truth, texts)
    scored = written_table(score_pairs(outcomes, rows).withColumnRenamed("model", "key"))
    scores = answers.select("model", "key", "query_id").join(scored, ["key", "query_id"]).drop("key")
    return query_results(catalogue_table(spark, entries), answers.drop("key"), scores)


def reward_completions(
    spark: SparkSession,
    open_tables: OpenTables,
    entries: Sequence[CatalogueQuery],
    completions: DataFrame,
) -> DataFrame:
    """Reward sampled completions (prompt_id, sample_no, text), where prompt_id is the
    query_id of a catalogue query.

    Samples that extract to the same sql are run and compared once per prompt."""
    truth = {e.query_id: e.sql for e in entries}
    cleaned = written_table(rewards.with_format_reward(completions))
    distinct = cleaned.filter("sql <> ''").select("prompt_id", "sql").distinct()
    keyed = written_table(distinct.withColumn("key", F.sha2("sql", 256)))
    runner = QueryRunner(spark, open_tables)
    texts = ((r["key"], r["prompt_id"], r["sql"]) for r in keyed.toLocalIterator())
    outcomes, rows = score_texts(runner, truth, texts)
    scores = score_pairs(outcomes, rows, training=True)
    verdicts = written_table(
        scores.select(
            F.col("model").alias("key"),
            F.col("query_id").alias("prompt_id"),
            F.col("execution_success").alias("ok"),
            "result_match",
        ).join(keyed, ["key", "prompt_id"])
    )
    # Whether a text runs does not depend on the prompt it was sampled for.
    executions = verdicts.groupBy("sql").agg(F.bool_or("ok").alias("ok"))
    rewarded = rewards.with_execution_reward(cleaned, executions)
    rewarded = rewards.with_correctness_reward(rewarded, verdicts)
    return rewards.with_total_reward(rewarded)
