"""Stored tables, the catalogue over them, and what the constraint checks find."""

import re
from dataclasses import replace
from datetime import date

import pytest
from tests.conftest import SMALL

from fleetlens.model import SCHEMAS, Tables
from fleetlens.operators.integrity import all_violations
from fleetlens.plans import reports
from fleetlens.plans.catalogue import EVAL, TRAIN, catalogue, catalogue_table
from fleetlens.plans.evaluation import report_truth
from fleetlens.registry import operators
from fleetlens.sources import runner
from fleetlens.sources.binding import AS_OF, bind
from fleetlens.sources.runner import QueryRunner, row_counts
from fleetlens.sources.tables import create_empty_tables, read_tables


@pytest.fixture(scope="module")
def tables(spark, stored):
    return read_tables(spark, stored)


def test_stored_tables_equal_bound_ones(spark, tables):
    bound = bind(spark, SMALL)
    assert tables.names() == bound.names()
    assert "quote_lines" not in tables.names()
    for name, df in tables.items():
        assert df.schema == SCHEMAS[name] or df.columns == SCHEMAS[name].names
        assert df.count() == getattr(bound, name).count() > 0


def test_every_catalogue_query_runs(spark, stored):
    entries = catalogue(AS_OF)
    for split, number in ((EVAL, 20), (TRAIN, 30)):
        texts = {e.query_id: e.sql for e in entries if e.split == split}
        assert len(texts) == number
        counts = row_counts(spark, lambda session: read_tables(session, stored), texts)
        rows = counts.collect()
        assert {r["query_id"] for r in rows} == set(texts)
        assert all(r["error"] is None and r["n_rows"] >= 0 for r in rows)


def test_counts_of_reports_texts_and_failures(spark, stored, tables):
    found = row_counts(
        spark,
        lambda session: read_tables(session, stored, optional=False),
        {
            1: "SELECT id FROM customers ORDER BY id",
            2: "SELECT id FROM customers WHERE 1 = 0",
            3: reports.lifetime_spend_rank(tables, AS_OF),
            4: "SELECT no_column FROM customers",
            5: "SELECT id FROM no_table",
        },
    )
    rows = {r["query_id"]: r for r in found.collect()}
    assert rows[1]["n_rows"] == tables.customers.count() and rows[2]["n_rows"] == 0
    assert rows[3]["n_rows"] == reports.lifetime_spend_rank(tables, AS_OF).count() > 0
    assert [rows[n]["n_rows"] for n in (4, 5)] == [None, None]
    assert "no_column" in rows[4]["error"] and rows[5]["error"]


def test_a_failed_count_is_no_result(spark, monkeypatch):
    monkeypatch.setattr(operators, "_RANKED", {EVAL: [], TRAIN: []})
    given = [replace(e, sql="SELECT name FROM customers") for e in catalogue(AS_OF)[19:22]]
    monkeypatch.setattr(operators, "warehouse_catalogue", lambda days: given)
    rows = operators._catalogue_row_counts(spark, SMALL).collect()
    assert sorted((r["split"], r["query_id"]) for r in rows) == [(EVAL, 20), (TRAIN, 1), (TRAIN, 2)]
    assert {r["n_rows"] for r in rows} == {bind(spark, SMALL).customers.count()}
    given[1] = replace(given[1], sql="SELECT raise_error('second line') FROM customers")
    with pytest.raises(RuntimeError, match="query 1: .*second line"):
        operators._catalogue_row_counts(spark, SMALL)


def test_counts_have_no_time_limit(spark, stored, monkeypatch):
    limits = []

    class Runner(QueryRunner):
        def run_all(self, queries, action):
            limits.append(self.time_limit)
            return super().run_all(queries, action)

    monkeypatch.setattr(runner, "QueryRunner", Runner)
    found = row_counts(
        spark, lambda session: read_tables(session, stored), {1: "SELECT 1 AS one"}
    )
    assert limits == [None] and found.first()["n_rows"] == 1


def test_what_breaks_the_runner_is_raised_or_told(spark, stored, monkeypatch):
    texts = QueryRunner(spark, lambda session: read_tables(session, stored))

    def broken(*_):
        raise KeyError("lost")

    error, found = texts.run_all({"a": "SELECT 1 AS one"}, broken)["a"]
    assert "lost" in error and found is None
    monkeypatch.setattr(texts, "_run_one", broken)
    with pytest.raises(KeyError, match="lost"):
        texts.run_all({"a": "SELECT 1 AS one", "b": "SELECT 2 AS two"}, broken)


def test_only_the_asked_reports_are_truth(spark, tables):
    assert set(report_truth(tables, AS_OF, TRAIN, only=[23, 27])) == {23, 27}
    assert set(report_truth(tables, AS_OF)) == set(range(1, 21))


def test_counted_queries_rank_in_no_single_partition(spark, stored, tables):
    """Texts 6, 23 and 27 have a window over all rows, and no other text has.  The report
    counted instead of 6 has one over the row counts (__n) of its ranges only."""
    lone = r"Window (\[.*)\n.*\n?.*SinglePartition"
    for split, ranked in ((EVAL, {6}), (TRAIN, {23, 27})):
        runner = QueryRunner(spark, lambda session: read_tables(session, stored, optional=False))
        wide = set()
        for e in catalogue(AS_OF):
            if e.split == split:
                plan = runner.query(e.sql)._jdf.queryExecution().executedPlan().toString()
                if re.search(lone, plan):
                    wide.add(e.query_id)
        assert wide == ranked
    for report in report_truth(tables, AS_OF, EVAL, only=[6]).values():
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert all("(__n#" in window for window in re.findall(lone, plan))


def test_catalogue_is_pinned_to_its_date(spark):
    entries = catalogue(date(2026, 3, 4))
    assert [e.difficulty for e in entries[:20]] == ["easy"] * 7 + ["medium"] * 7 + ["hard"] * 6
    assert [e.difficulty for e in entries[20:]] == ["easy"] * 12 + ["medium"] * 10 + ["hard"] * 8
    assert "DATE '2025-09-05'" in entries[0].sql
    assert catalogue_table(spark, entries).count() == 50


def test_empty_tables_are_typed(spark, tmp_path):
    create_empty_tables(spark, str(tmp_path / "empty"))
    empty = read_tables(spark, str(tmp_path / "empty"))
    assert empty.names() == list(SCHEMAS)
    assert reports.account_health(empty, AS_OF).count() == 0
    assert reports.high_value_accounts(empty, AS_OF).count() == 0
    assert reports.lifetime_spend_rank(empty, AS_OF).count() == 0
    assert dict(empty.quotes.dtypes)["sent_date"] == "date"


def test_violations_are_found(spark, tables):
    def found(given):
        return {
            (r["table_name"], r["check_name"], r["column_name"]): r["bad"]
            for r in all_violations(Tables(given)).collect()
        }

    given = dict(tables.items())
    before = found(given)
    used = tables.orders.first()["id"]
    bad_order = spark.createDataFrame(
        [(used, 999999, 1, date(2025, 1, 1), 1.0, "lost")], tables.orders.schema
    )
    given["orders"] = tables.orders.unionByName(bad_order)
    after = found(given)
    grown = {check for check in after if after[check] != before[check]}
    assert grown >= {
        ("orders", "allowed_values", "status"),
        ("orders", "unique", "id"),
        ("orders", "foreign_key", "customer_id"),
        ("orders", "derived_total", "total_value"),
    }
    assert all(after[check] >= before[check] for check in grown)
