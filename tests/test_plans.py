"""What the plans of the reports must and must not contain."""

import re
from datetime import date

import pytest
from tests.conftest import SMALL

from fleetlens.plans import reports
from fleetlens.sources.binding import AS_OF, bind
from fleetlens.sources.tables import read_tables

ALL = {**{f"q{n}": r for n, r in reports.EVAL_REPORTS.items()},
       **{f"t{n}": r for n, r in reports.TRAINING_REPORTS.items()}}


def plan(df):
    return df._jdf.queryExecution().explainString(
        df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", sorted(ALL))
def test_no_cross_joins_or_python(spark, name):
    text = plan(ALL[name](bind(spark, SMALL), AS_OF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in text


@pytest.mark.parametrize("name", sorted(set(ALL) - {"t27"}))
def test_no_window_over_the_whole_table(spark, name):
    """t27 has one row per month; ranked reports have one row per range."""
    text = plan(ALL[name](bind(spark, SMALL), AS_OF))
    if "SinglePartition" in text and re.search(r"\bWindow\b", text):
        assert name in {"q6", "t23"}


def test_filters_and_columns_reach_stored_tables(spark, stored):
    today, tables = date(2026, 3, 4), read_tables(spark, stored)
    text = plan(reports.stale_quotes(tables, today))
    assert "EqualTo(status,sent)" in text and "LessThan(sent_date,2026-01-18)" in text
    assert "ReadSchema: struct<id:bigint,name:string>" in text
    text = plan(reports.revenue_this_year(tables, today))
    assert "GreaterThanOrEqual(order_date,2026-01-01)" in text
    assert "LessThan(order_date,2027-01-01)" in text


def test_status_filters_reach_the_warehouse(spark):
    text = plan(reports.completed_revenue(bind(spark, SMALL), AS_OF))
    assert "EqualNullSafe(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in text


def test_unread_dimension_columns_cost_no_join(spark):
    text = plan(reports.account_health(bind(spark, SMALL), AS_OF))
    assert "nation.parquet" not in text


def test_aggregates_stay_hash_based(spark):
    text = plan(reports.uncontracted_value(bind(spark, SMALL), AS_OF))
    assert "SortAggregate" not in text


def test_all_foreign_keys_read_a_table_twice_at_most(spark, stored):
    from fleetlens.operators import integrity

    tables = read_tables(spark, stored)
    plan = integrity.all_violations(tables, kinds=("foreign_key",))._jdf.queryExecution()
    scans = str(plan.optimizedPlan().toString()).count("Relation [")
    children = {"customers", "machines", "service_contracts", "orders", "order_lines", "quotes"}
    parents = {"account_managers", "customers", "products", "machines", "orders", "quotes"}
    assert 0 < scans <= len(children) + len(parents) + 1
