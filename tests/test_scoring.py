"""Query texts, score files, rollups, chat samples and rewards end to end."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import chat, compare, rewards
from fleetlens.plans import scoreboard
from fleetlens.plans.catalogue import EVAL, catalogue, catalogue_table
from fleetlens.sources import results
from fleetlens.sources.binding import AS_OF
from fleetlens.sources.checkpoints import written_table
from fleetlens.sources.runner import QueryRunner, score_texts
from fleetlens.sources.tables import read_tables

ENTRIES = [e for e in catalogue(AS_OF) if e.split == EVAL and e.query_id in (2, 4, 7, 11)]
TRUTH = {e.query_id: e.sql for e in ENTRIES}


@pytest.fixture(scope="module")
def runner(spark, stored):
    return QueryRunner(spark, lambda session: read_tables(session, stored))


ANSWERS = [
    ("good-1.0", 2, TRUTH[2]),
    ("good-1.0", 4, TRUTH[4] + ";"),
    ("good-1.0", 7, "SELECT name, 0 AS n FROM customers WHERE id <= 80"),
    ("good-1.0", 11, "SELECT name FROM account_managers"),
    ("bad", 2, "DROP TABLE quotes"),
    ("bad", 4, ""),
    ("bad", 7, "SELECT 1) UNION SELECT (2"),
    ("bad", 11, "SELECT raise_error('late') AS name FROM customers"),
]


@pytest.fixture(scope="module")
def scores(runner):
    outcomes, rows = score_texts(runner, TRUTH, ANSWERS)
    return compare.score_pairs(outcomes, rows)


def test_only_queries_run(runner, scores):
    got = {(r["model"], r["query_id"]): r for r in scores.collect()}
    assert [got["good-1.0", q]["result_match"] for q in (2, 4, 7, 11)] == [1.0, 1.0, 0.5, 1.0]
    for q in (2, 4, 7, 11):
        row = got["bad", q]
        assert (row["execution_success"], row["result_match"]) == (False, 0.0)
        assert row["execution_error"]
        assert row["gt_error"] is None
    assert runner.query("SELECT * FROM quotes").count() > 0


def test_views_stay_in_the_runner(spark, runner):
    names = {t.name for t in spark.catalog.listTables()}
    assert "service_contracts" not in names


def test_score_files_and_rollups(spark, scores, tmp_path):
    answers = spark.createDataFrame(ANSWERS, "model string, query_id int, sql string")
    flat = scoreboard.query_results(catalogue_table(spark, ENTRIES), answers, scores)
    folder = tmp_path / "scores"
    results.write_score_files(flat, str(folder))
    assert {p.name for p in folder.iterdir() if p.is_dir()} == {
        "file=results_good-1_0", "file=results_bad",
    }
    read = results.read_score_files(spark, str(folder))
    records = scoreboard.benchmark_records(flat, "2026-03-04T00:00:00")
    documents = str(tmp_path / "documents")
    results.write_score_documents(records, documents)
    again = results.read_score_documents(spark, documents + "/file=results_*")
    assert again.select("timestamp", "total_queries").distinct().count() == 1
    again = again.drop("timestamp", "total_queries")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(
        map(tuple, read.collect()), key=repr
    )
    summary = {r["model_name"]: r for r in scoreboard.model_summary(read).collect()}
    good, bad = summary["good-1.0"], summary["bad"]
    assert (good["total_queries"], good["queries_passed"]) == (4, 3)
    assert (good["execution_accuracy"], good["result_match_avg"]) == (1.0, 0.875)
    assert (bad["execution_accuracy"], bad["result_match_avg"]) == (0.0, 0.0)

    statuses = read.select("model_name", "query_id", scoreboard.run_status().alias("s"))
    assert {r["s"] for r in statuses.filter("model_name = 'bad'").collect()} == {"ERROR"}
    assert {r["query_id"]: r["s"] for r in statuses.filter("model_name <> 'bad'").collect()}[7] == "PARTIAL"
    levels = [tuple(r) for r in scoreboard.score_by_difficulty(read).collect()]
    assert levels == [
        ("easy", "bad", 0.0), ("easy", "good-1.0", 2.5 / 3),
        ("medium", "bad", 0.0), ("medium", "good-1.0", 1.0),
    ]
    long = {(r["query_id"], r["model"]): r["mean_match"] for r in scoreboard.model_comparison(read).collect()}
    assert {q: m for (q, name), m in long.items() if name != "bad"} == {2: 1.0, 4: 1.0, 7: 0.5, 11: 1.0}
    assert {m for (_, name), m in long.items() if name == "bad"} == {0.0}
    detail = {(r["model_name"], r["query_id"]): r for r in scoreboard.detail_table(read).collect()}
    assert detail["good-1.0", 7]["status"] == "Partial"
    assert detail["good-1.0", 7]["ground_truth_row_count"] == 150
    assert detail["good-1.0", 7]["generated_row_count"] == 81
    assert scoreboard.match_table(read).filter("query = 'Q11'").count() == 2


def test_indented_document_with_rows(spark, tmp_path):
    document = {
        "model_name": "m", "timestamp": "t", "total_queries": 1, "execution_accuracy": 1.0,
        "result_match_avg": 1.0,
        "results": [{
            "query_id": 1, "question": "q", "difficulty": "easy", "ground_truth_sql": "s",
            "generated_sql": "s", "execution_success": True, "execution_error": None,
            "ground_truth_rows": [[1, "x"], [2, None]], "generated_rows": [],
            "result_match": 1.0,
        }],
    }
    (tmp_path / "results_m.json").write_text(json.dumps(document, indent=2))
    row = results.read_score_documents(spark, str(tmp_path / "results_*.json")).first()
    assert (row["ground_truth_row_count"], row["generated_row_count"]) == (2, 0)
    assert row["result_match"] == 1.0


def test_status_labels(spark):
    df = spark.createDataFrame(
        [(1.0, True), (0.5, True), (0.0, True), (0.0, False), (None, True)],
        "result_match double, execution_success boolean",
    )
    got = df.select(scoreboard.run_status().alias("r"), scoreboard.detail_status().alias("d")).collect()
    assert [r["r"] for r in got] == ["MATCH", "PARTIAL", "FAIL", "ERROR", "UNSCORED"]
    assert [r["d"] for r in got] == ["Pass", "Partial", "Fail", "Fail", "Unscored"]


def test_prompt_names_every_table_and_the_day():
    prompt = chat.system_prompt(date(2026, 3, 4))
    assert "2026-03-04" in prompt and "quote_lines" in prompt and "churn signal" in prompt
    assert "status: string; one of draft, sent, won, lost, expired" in prompt


def test_chat_rows(spark):
    table = catalogue_table(spark, ENTRIES)
    first = chat.prompt_rows(table, "P").orderBy("query_id").first()
    assert [(m["role"]) for m in first["prompt"]] == ["system", "user"]
    assert first["ground_truth_sql"] == TRUTH[2].strip()
    messages = chat.supervised_rows(table, "P").orderBy("query_id").first()["messages"]
    assert [m["role"] for m in messages] == ["system", "user", "assistant"]
    assert messages[2]["content"] == TRUTH[2].strip()


def test_train_and_eval_questions_do_not_overlap(spark):
    table = catalogue_table(spark, catalogue(AS_OF))
    train, held_out = table.filter("split = 'train'"), table.filter("split = 'eval'")
    assert chat.overlapping_questions(train, held_out, "question").count() == 0
    assert chat.overlapping_questions(train, held_out, "sql").count() == 0
    shouted = held_out.limit(2).withColumn("question", F.concat(F.lit(" "), F.upper("question")))
    assert chat.overlapping_questions(shouted, held_out, "question").count() == 2


def test_rewards(spark):
    completions = spark.createDataFrame(
        [
            (1, 1, "```sql\nselect a;\n```"),
            (1, 2, "WITH x AS (SELECT 1) SELECT 1"),
            (1, 3, ""),
            (1, 4, "<think>hm</think>select b"),
        ],
        "prompt_id int, sample_no int, text string",
    )
    executions = spark.createDataFrame(
        [("select a;", True), ("WITH x AS (SELECT 1) SELECT 1", True), ("select b", False), ("", True)],
        "sql string, ok boolean",
    )
    verdicts = spark.createDataFrame(
        [(1, "select a;", 1.0), (1, "WITH x AS (SELECT 1) SELECT 1", 0.5), (1, "", 1.0), (1, "select b", None)],
        "prompt_id int, sql string, result_match double",
    )
    scored = rewards.with_total_reward(
        rewards.with_correctness_reward(
            rewards.with_execution_reward(rewards.with_format_reward(completions), executions),
            verdicts,
        )
    )
    got = [tuple(r) for r in scored.orderBy("sample_no").select(
        "format_reward", "execution_reward", "correctness_reward", "reward").collect()]
    assert got == [(0.25, 0.5, 1.0, 1.75), (0.0, 0.5, 0.5, 1.0), (0.0, 0.0, 0.0, 0.0), (0.25, 0.0, 0.0, 0.25)]
    group = rewards.group_statistics(scored).first()
    assert (group["samples"], group["mean_reward"], group["max_reward"]) == (4, 0.75, 1.75)


def test_written_tables_go_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    table = written_table(spark.range(3).withColumnRenamed("id", "x"))
    assert sorted(r["x"] for r in table.collect()) == [0, 1, 2]
    assert all(named in path for path in table.inputFiles())
