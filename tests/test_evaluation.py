"""Raw model texts to scores and rewards."""

import pytest

from fleetlens.operators.rewards import group_statistics
from fleetlens.plans import scoreboard
from fleetlens.plans.catalogue import EVAL, TRAIN, catalogue
from fleetlens.plans.evaluation import (
    evaluate_responses,
    report_truth,
    reward_completions,
)
from fleetlens.sources.binding import AS_OF
from fleetlens.sources.tables import read_tables

ENTRIES = [e for e in catalogue(AS_OF) if e.split == EVAL and e.query_id in (2, 11)]
SQL = {e.query_id: e.sql for e in ENTRIES}


@pytest.fixture(scope="module")
def open_tables(stored):
    return lambda session: read_tables(session, stored)


def test_responses_to_summary(spark, open_tables):
    responses = spark.createDataFrame(
        [
            ("a", 2, f"<think>easy</think>\n```sql\n{SQL[2]};\n```\nDone."),
            ("a", 11, f"```\n{SQL[11]}\n```"),
            ("b", 2, "I cannot answer that."),
            ("b", 11, None),
        ],
        "model string, query_id int, raw string",
    )
    results = evaluate_responses(spark, open_tables, ENTRIES, responses)
    summary = {r["model_name"]: r for r in scoreboard.model_summary(results).collect()}
    assert (summary["a"]["execution_accuracy"], summary["a"]["result_match_avg"]) == (1.0, 1.0)
    assert (summary["b"]["execution_accuracy"], summary["b"]["result_match_avg"]) == (0.0, 0.0)
    assert results.filter("model_name = 'b' AND execution_error IS NULL").count() == 0


def test_completions_to_rewards(spark, open_tables):
    short = "SELECT id FROM quotes WHERE status = 'sent'"
    completions = spark.createDataFrame(
        [
            (2, 1, SQL[2]),
            (2, 2, f"```sql\n{SQL[2]}\n```"),
            (2, 3, "SELECT nothing FROM nowhere"),
            (2, 4, ""),
            (2, 5, short),
            (11, 1, f"WITH x AS (SELECT 1) SELECT * FROM ({SQL[11]})"),
        ],
        "prompt_id int, sample_no int, text string",
    )
    rewarded = reward_completions(spark, open_tables, ENTRIES, completions)
    got = {
        (r["prompt_id"], r["sample_no"]): (
            r["format_reward"], r["execution_reward"], r["correctness_reward"]
        )
        for r in rewarded.collect()
    }
    assert got == {
        (2, 1): (0.25, 0.5, 1.0),
        (2, 2): (0.25, 0.5, 1.0),
        (2, 3): (0.25, 0.0, 0.0),
        (2, 4): (0.0, 0.0, 0.0),
        # All stale quotes are sent ones, but other sent quotes make the bags differ.
        (2, 5): (0.25, 0.5, 0.5),
        (11, 1): (0.0, 0.5, 1.0),
    }
    groups = {r["prompt_id"]: r["samples"] for r in group_statistics(rewarded).collect()}
    assert groups == {2: 5, 11: 1}


@pytest.mark.parametrize("split", [EVAL, TRAIN])
def test_catalogue_texts_answer_the_reports(spark, open_tables, split):
    """Every SQL text scores full marks against the report it states."""
    entries = [e for e in catalogue(AS_OF) if e.split == split]
    responses = spark.createDataFrame(
        [("sql", e.query_id, e.sql) for e in entries], "model string, query_id int, raw string"
    )
    truth = report_truth(open_tables(spark), AS_OF, split)
    results = evaluate_responses(spark, open_tables, entries, responses, truth)
    assert results.filter("result_match IS NULL OR result_match < 1").collect() == []
    assert results.count() == len(entries)
