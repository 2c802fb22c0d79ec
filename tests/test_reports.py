"""Hand-made tables for what the fixtures cannot show."""

from datetime import date

import pytest

from fleetlens.model import SCHEMAS, Tables
from fleetlens.plans import definitions as d
from fleetlens.plans import reports

AS_OF = date(2026, 3, 4)


@pytest.fixture(scope="module")
def make(spark):
    def build(**given):
        tables = {
            name: spark.createDataFrame(given.get(name, []), schema)
            for name, schema in SCHEMAS.items()
        }
        return Tables(tables)

    return build


def customer(i, status="active", manager=1, segment="smb"):
    return (i, f"C{i}", "UK", segment, manager, date(2023, 1, 1), status)


def machine(i, owner, product=1, status="active", day=date(2024, 1, 1)):
    return (i, owner, product, f"SN-{i}", day, status)


def contract(i, owner, unit, status="active", value=100.0):
    return (i, owner, unit, date(2025, 1, 1), date(2026, 12, 31), value, status)


def order(i, buyer, day, value=10.0, status="completed"):
    return (i, buyer, 1, day, value, status)


PRODUCTS = [(1, "Mill", "M", 1000.0, "equipment"), (2, "Bit", "M", 10.0, "spare_part")]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_two_contracts_count_twice_in_penetration_but_once_per_machine(make):
    t = make(
        customers=[customer(1)],
        products=PRODUCTS,
        machines=[machine(1, 1), machine(2, 1)],
        service_contracts=[contract(1, 1, 1), contract(2, 1, 1)],
    )
    assert rows(reports.contract_penetration(t, AS_OF)) == [("C1", 3, 2, 66.7)]
    assert rows(reports.expansion_potential(t, AS_OF)) == [("C1", 3, 1.0)]
    assert rows(reports.partly_contracted_customers(t, AS_OF)) == [("C1", 1, 1)]
    assert rows(reports.uncontracted_value(t, AS_OF)) == [("C1", 3, 2, 1, 1000.0)]


def test_never_ordered_customer_is_at_risk(make):
    t = make(
        customers=[customer(1), customer(2), customer(3, "inactive"), customer(4), customer(5)],
        machines=[machine(1, 1), machine(2, 2), machine(3, 3), machine(4, 4, status="decommissioned")],
        orders=[
            order(1, 2, date(2026, 1, 1)),
            order(2, 1, date(2026, 1, 1), status="cancelled"),
        ],
    )
    assert rows(reports.at_risk_accounts(t, AS_OF)) == [(1, "C1", "UK", None)]


def test_at_risk_cutoff_is_strict(make):
    edge = date(2025, 9, 5)  # 180 days before
    t = make(
        customers=[customer(1), customer(2)],
        machines=[machine(1, 1), machine(2, 2)],
        orders=[order(1, 1, edge), order(2, 2, date(2025, 9, 4))],
    )
    assert [r[0] for r in rows(reports.at_risk_accounts(t, AS_OF))] == [2]


def test_stale_quote_needs_sent_status_and_older_date(make):
    quote = lambda i, sent, status: (i, 1, 1, date(2025, 1, 1), sent, None, 5.0, status)
    t = make(
        customers=[customer(1)],
        quotes=[
            quote(1, date(2026, 1, 17), "sent"),
            quote(2, date(2026, 1, 18), "sent"),  # exactly 45 days
            quote(3, date(2026, 1, 1), "won"),
            quote(4, None, "draft"),
        ],
    )
    assert [r[0] for r in rows(reports.stale_quotes(t, AS_OF))] == [1]


def test_missing_quarters_are_skipped(make):
    days = [date(2024, 1, 5)] * 3 + [date(2024, 8, 5)] * 2 + [date(2025, 11, 5)]
    t = make(
        customers=[customer(1), customer(2)],
        orders=[order(i, 1, day) for i, day in enumerate(days)]
        + [order(100 + i, 2, day) for i, day in enumerate(days[:5])],
    )
    assert rows(reports.declining_frequency(t, AS_OF)) == [("C1",)]


def test_tied_quintile_edge_is_cut_by_customer(make):
    t = make(
        customers=[customer(i) for i in range(1, 8)],
        orders=[order(i, i, date(2025, 1, 1), 10.0) for i in range(1, 8)],
    )
    # Seven rows in five tiles: 2, 2, 1, 1, 1.
    assert rows(d.high_value_accounts(t)) == [(7, 10.0)]


def test_first_spare_part_is_of_all_time(make):
    t = make(
        customers=[customer(1)],
        products=PRODUCTS,
        machines=[machine(1, 1, day=date(2024, 1, 1)), machine(2, 1, day=date(2024, 6, 1))],
        orders=[order(1, 1, date(2024, 3, 1)), order(2, 1, date(2025, 3, 1))],
        order_lines=[(1, 1, 2, 1, 10.0, 10.0), (2, 2, 2, 1, 10.0, 10.0)],
    )
    # The machine installed after the first spare part is left out.
    assert rows(reports.days_to_first_spare_part(t, AS_OF)) == [("Mill", 60.0)]


def test_manager_without_customers_gets_zeros(make):
    t = make(account_managers=[(7, "Zed", "z@x", "EMEA")], customers=[customer(1)])
    assert rows(reports.manager_summary(t, AS_OF)) == [("Zed", 0, 0, 0.0)]
    assert rows(reports.manager_workload(t, AS_OF)) == [("Zed", 0, 0)]


def test_health_grades(make):
    t = make(
        customers=[customer(1), customer(2), customer(3)],
        orders=[order(1, 1, date(2026, 2, 1)), order(2, 2, date(2026, 2, 1))],
        quotes=[
            (i, buyer, 1, date(2025, 1, 1), date(2025, 2, 1), None, 5.0, "sent")
            for i, buyer in ((1, 2), (2, 2), (3, 3))
        ],
    )
    assert rows(reports.account_health(t, AS_OF)) == [
        ("C3", "smb", 2, "at-risk"),
        ("C2", "smb", 1, "watch"),
        ("C1", "smb", 0, "healthy"),
    ]


def test_top_line_keeps_ties(make):
    t = make(
        customers=[customer(1)],
        products=PRODUCTS,
        orders=[order(1, 1, date(2025, 1, 1))],
        order_lines=[(1, 1, 1, 1, 5.0, 5.0), (2, 1, 2, 1, 5.0, 5.0), (3, 1, 2, 1, 4.0, 4.0)],
    )
    assert rows(reports.top_line_per_order(t, AS_OF)) == [
        (1, "C1", "Mill", 5.0),
        (1, "C1", "Bit", 5.0),
    ]


def test_equipment_buyers_of_every_status_without_spare_parts(make):
    t = make(
        customers=[customer(1, "churned"), customer(2)],
        products=PRODUCTS,
        orders=[
            order(1, 1, date(2025, 1, 1)),
            order(2, 1, date(2025, 1, 1), status="pending"),
            order(3, 2, date(2025, 1, 1)),
            order(4, 2, date(2025, 1, 2)),
        ],
        order_lines=[
            (1, 1, 1, 1, 5.0, 5.0),
            (2, 2, 2, 1, 5.0, 5.0),  # not completed: does not count
            (3, 3, 1, 1, 5.0, 5.0),
            (4, 4, 2, 1, 5.0, 5.0),
        ],
    )
    assert rows(reports.equipment_without_spare_parts(t, AS_OF)) == [(1, "C1")]
