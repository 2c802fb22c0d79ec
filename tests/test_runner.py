"""What the runner refuses, records and stops."""

import pytest

from fleetlens.sources.checkpoints import checkpoint_dir
from fleetlens.sources.runner import QueryRunner, RefusedText
from fleetlens.sources.tables import read_tables


@pytest.fixture(scope="module")
def runner(spark, stored):
    return QueryRunner(spark, lambda session: read_tables(session, stored), time_limit=20)


def errors(runner, *texts):
    entries = [("m", i, "gen", text) for i, text in enumerate(texts)]
    outcomes, rows = runner.store(entries, checkpoint_dir(runner.spark))
    counts = {r["query_id"]: r["count"] for r in rows.groupBy("query_id").count().collect()}
    found = {r["query_id"]: r["error"] for r in outcomes.collect()}
    return [found[i] for i in range(len(texts))], counts


def test_every_error_is_recorded_whole(runner):
    said, counts = errors(
        runner,
        "SELECT id FROM customers WHERE id = (SELECT id FROM customers)",
        "SELECT no_such_column FROM customers",
        "SELECT 1 AS one",
        "SELECT raise_error('first line\nsecond line') FROM customers",
        "",
    )
    assert "SCALAR_SUBQUERY_TOO_MANY_ROWS" in said[0]
    assert "no_such_column" in said[1]
    assert said[2] is None and counts == {2: 1}
    assert "second line" in said[3]
    assert said[4]


ESCAPES = [
    "SELECT java_method('java.lang.System', 'getProperty', 'user.name')",
    "SELECT `reflect` ('java.lang.System', 'getProperty', 'user.name')",
    "SELECT try_reflect/* x */('java.lang.System', 'exit', 1)",
    "SELECT 1 AS `'`, java_method('java.lang.Math', 'abs', -5)",
    "SELECT * FROM VALUES (java_method('java.lang.Math', 'abs', -5)) AS t(x)",
    "SELECT id FROM customers LIMIT java_method('java.lang.Math', 'abs', -5)",
    "SELECT id FROM customers WHERE id = (SELECT reflect('java.lang.Math', 'abs', -5))",
    "WITH x AS (SELECT reflect('java.lang.Math', 'abs', -5) AS y) SELECT y FROM x",
    "SELECT IDENTIFIER('java_' || 'method')('java.lang.Math', 'abs', -5)",
    "SELECT * FROM VALUES (IDENTIFIER('reflect')('java.lang.Math', 'abs', -5)) AS t(x)",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM customers",
    "SELECT * FROM (SELECT TRANSFORM(id) USING 'cat' AS (x) FROM customers) WHERE x > 1",
    "SELECT id FROM customers WHERE EXISTS (SELECT TRANSFORM(id) USING 'cat' AS (x) FROM customers)",
    "SELECT from_protobuf(X'00', 'm', '/etc/passwd')",
    "SELECT own_function(id) FROM customers",
    "SELECT * FROM not_given",
    "SELECT * FROM IDENTIFIER('not_' || 'given')",
    "SELECT * FROM stored_elsewhere.customers",
]


@pytest.mark.parametrize("text", ESCAPES)
def test_what_is_not_listed_is_refused(runner, text):
    runner.spark.range(3).createOrReplaceTempView("not_given")
    runner.spark.udf.register("own_function", lambda x: x, "long")
    with pytest.raises(RefusedText):
        runner.query(text)
    said, counts = errors(runner, text)
    assert "not allowed" in said[0] and not counts


QUERIES = [
    "SELECT 'reflect(this)' AS said -- java_method(x)",
    "SELECT 1 AS reflect, 2 AS `java_method('x')`",
    "FROM customers |> AGGREGATE COUNT(*) AS n",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 1) SELECT n FROM r",
    "SELECT COUNT(*) OVER w AS n FROM (SELECT * FROM customers LIMIT 1) WINDOW w AS (ORDER BY id)",
    "SELECT a.x FROM VALUES (1, 2) AS a(x, y), LATERAL (SELECT a.x + 1 AS z) WHERE x IN (SELECT 1)",
    "SELECT MAX(id) AS m FROM customers c WHERE EXISTS (SELECT 1 FROM customers d WHERE d.id = c.id)",
]


@pytest.mark.parametrize("text", QUERIES)
def test_queries_of_all_shapes_run(runner, text):
    assert runner.query(text).count() == 1


def test_every_catalogue_text_is_admitted(runner):
    from datetime import date

    from fleetlens.plans.catalogue import catalogue

    for entry in catalogue(date(2026, 3, 4)):
        assert runner.query(entry.sql).columns


def test_files_are_not_tables(runner, stored):
    said, _ = errors(runner, f"SELECT * FROM parquet.`{stored}/customers`")
    assert said[0]


ENDLESS = "(SELECT COUNT(*) FROM range(1000000000) a JOIN range(1000) b ON a.id % 7 <> b.id + {})"


def test_a_long_text_is_stopped(spark, stored):
    quick = QueryRunner(spark, lambda session: read_tables(session, stored), time_limit=4.0)
    said, counts = errors(quick, ENDLESS.format(0).strip("()"), "SELECT 2 AS two")
    assert said[0].startswith("stopped after 4 seconds") and said[1] is None
    assert counts == {1: 1}


def test_a_text_of_many_jobs_is_stopped_for_good(spark, stored):
    import time

    quick = QueryRunner(spark, lambda session: read_tables(session, stored), time_limit=3.0)
    many = "SELECT " + " + ".join(ENDLESS.format(i) for i in range(5)) + " AS n"
    said, counts = errors(quick, many)
    assert said[0].startswith("stopped after 3 seconds") and not counts
    time.sleep(2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_a_text_stuck_between_jobs_is_left_behind(spark, stored, monkeypatch):
    import time

    quick = QueryRunner(
        spark, lambda session: read_tables(session, stored), time_limit=1.0, grace=1.0
    )
    plan = quick.query
    monkeypatch.setattr(quick, "query", lambda t: time.sleep(8) or plan(t) if "1" in t else plan(t))
    start = time.monotonic()
    said, _ = errors(quick, "SELECT 1 AS one")
    assert said[0].startswith("stopped after 1 seconds: no answer")
    assert time.monotonic() - start < 8
    time.sleep(8)  # its later jobs are refused
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_equal_texts_run_once_and_stay_apart(runner):
    entries = [("a", 1, "gen", "SELECT 7 AS x"), ("b", 1, "gen", "SELECT 7 AS x")]
    outcomes, rows = runner.store(entries * 2, checkpoint_dir(runner.spark))
    assert outcomes.count() == 4
    assert {r["model"] for r in rows.collect()} == {"a", "b"}
