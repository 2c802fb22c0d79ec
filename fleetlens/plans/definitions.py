"""The nine business definitions, as reusable DataFrames.

Two rules hold everywhere.  Facts are aggregated to one row per key before they meet
another table, so a customer owning a third of all rows is folded on the map side and
never crosses the network as raw rows.  The right side of a semi or anti join is made
distinct first for the same reason.  No join carries a broadcast hint: Spark
broadcasts a side only when its statistics or its measured shuffle size are under the
threshold, and otherwise shuffles both with adaptive skew splitting.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.dates import days_before, months_before
from fleetlens.functions.numbers import ratio
from fleetlens.model import Tables
from fleetlens.operators.ranking import global_ntile
from fleetlens.sources.checkpoints import written_table


def with_status(df: DataFrame, *values: str) -> DataFrame:
    return df.filter(F.col("status").isin(*values) if len(values) > 1
                     else F.col("status") == values[0])


def distinct_keys(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).distinct()


def last_completed_order(t: Tables) -> DataFrame:
    """buyer_id, last_order_date."""
    return (
        with_status(t.orders, "completed")
        .groupBy(F.col("customer_id").alias("buyer_id"))
        .agg(F.max("order_date").alias("last_order_date"))
    )


def active_machine_counts(t: Tables) -> DataFrame:
    """owner_id, active_machines."""
    return (
        with_status(t.machines, "active")
        .groupBy(F.col("customer_id").alias("owner_id"))
        .agg(F.count("id").alias("active_machines"))
    )


def machine_coverage(t: Tables) -> DataFrame:
    """One row per active machine: id, owner_id, product_id, contracts (active ones)."""
    contracts = (
        with_status(t.service_contracts, "active")
        .groupBy(F.col("machine_id").alias("covered_id"))
        .agg(F.count("id").alias("n"))
    )
    return (
        with_status(t.machines, "active")
        .join(contracts, F.col("id") == F.col("covered_id"), "left")
        .select(
            "id",
            F.col("customer_id").alias("owner_id"),
            "product_id",
            F.coalesce("n", F.lit(0)).alias("contracts"),
        )
    )


def coverage_totals(coverage: DataFrame, *more) -> DataFrame:
    """Counts per owner.  A machine under two active contracts counts twice in both
    terms, because the definition counts machine-contract pairs."""
    return coverage.groupBy("owner_id").agg(
        F.sum(F.greatest("contracts", F.lit(1))).alias("total_machines"),
        F.sum("contracts").alias("contracted_machines"),
        *more,
    )


def at_risk_accounts(t: Tables, as_of: date, days: int = 180) -> DataFrame:
    """Active customers that own an active machine and have no completed order in the
    last `days` days, those that never ordered included."""
    owners = distinct_keys(with_status(t.machines, "active"), "customer_id", "owner_id")
    return (
        with_status(t.customers, "active")
        .join(last_completed_order(t), F.col("id") == F.col("buyer_id"), "left")
        .filter(
            F.col("last_order_date").isNull()
            | (F.col("last_order_date") < F.lit(days_before(as_of, days)))
        )
        .join(owners, F.col("id") == F.col("owner_id"), "left_semi")
        .select("id", "name", "country", "account_manager_id", "last_order_date")
    )


def stale_quotes(t: Tables, as_of: date, days: int = 45) -> DataFrame:
    return with_status(t.quotes, "sent").filter(
        F.col("sent_date") < F.lit(days_before(as_of, days))
    )


def service_penetration(t: Tables) -> DataFrame:
    """owner_id, total_machines, contracted_machines, penetration_pct."""
    return coverage_totals(machine_coverage(t)).withColumn(
        "penetration_pct",
        F.round(ratio(F.col("contracted_machines") * 100.0, F.col("total_machines")), 1),
    )


def lifetime_value(t: Tables) -> DataFrame:
    """customer_id, lifetime_value of completed orders; written, as it will be ranked."""
    return written_table(
        with_status(t.orders, "completed")
        .groupBy("customer_id")
        .agg(F.sum("total_value").alias("lifetime_value"))
    )


def high_value_accounts(t: Tables, tiles: int = 5) -> DataFrame:
    """customer_id, lifetime_value of the top tile by completed order value.  Equal
    values are ordered by customer, so the cut is repeatable."""
    tiled = global_ntile(lifetime_value(t), "lifetime_value", "customer_id", tiles, "tile")
    return tiled.filter(F.col("tile") == tiles).drop("tile")


def cross_sell_candidates(t: Tables) -> DataFrame:
    """Customers of any status with active machines and no active contract."""
    under_contract = distinct_keys(
        with_status(t.service_contracts, "active"), "customer_id", "holder_id"
    )
    return (
        t.customers.join(active_machine_counts(t), F.col("id") == F.col("owner_id"))
        .join(under_contract, F.col("id") == F.col("holder_id"), "left_anti")
        .select("id", "name", "active_machines")
    )


def order_frequency(t: Tables, as_of: date, months: int = 6) -> DataFrame:
    """buyer_id, recent and prior: completed orders in the last `months` months and in
    as many months before those."""
    middle = F.lit(months_before(as_of, months))
    start = F.lit(months_before(as_of, 2 * months))
    when = F.col("order_date")
    return (
        with_status(t.orders, "completed")
        .filter(when >= start)
        .groupBy(F.col("customer_id").alias("buyer_id"))
        .agg(
            F.count_if(when >= middle).alias("recent"),
            F.count_if(when < middle).alias("prior"),
        )
    )


def churn_signal(t: Tables, as_of: date, months: int = 6) -> DataFrame:
    """id, name, recent, prior where recent < prior.  That needs a prior order, so
    customers absent from the frequency table can never qualify."""
    declining = order_frequency(t, as_of, months).filter(F.col("recent") < F.col("prior"))
    return t.customers.join(declining, F.col("id") == F.col("buyer_id")).select(
        "id", "name", "recent", "prior"
    )


def expansion_potential(t: Tables) -> DataFrame:
    """owner_id, total_machines, expansion_potential.  The ratio is rounded to four
    places before use."""
    share = F.round(ratio(F.col("contracted_machines"), F.col("total_machines")), 4)
    return coverage_totals(machine_coverage(t)).select(
        "owner_id",
        "total_machines",
        F.round(F.col("total_machines") * (1 - share), 2).alias("expansion_potential"),
    )


def active_accounts(t: Tables, as_of: date, months: int = 12) -> DataFrame:
    """Customers with at least one completed order in the last `months` months."""
    recent = with_status(t.orders, "completed").filter(
        F.col("order_date") >= F.lit(months_before(as_of, months))
    )
    buyers = distinct_keys(recent, "customer_id", "buyer_id")
    return t.customers.join(buyers, F.col("id") == F.col("buyer_id"), "left_semi")


def revenue_at_risk(t: Tables, as_of: date, days: int = 180, months: int = 12) -> DataFrame:
    """One row: completed order value of the last `months` months of at-risk accounts."""
    spend = (
        with_status(t.orders, "completed")
        .filter(F.col("order_date") >= F.lit(months_before(as_of, months)))
        .groupBy(F.col("customer_id").alias("spender_id"))
        .agg(F.sum("total_value").alias("annual_spend"))
    )
    return (
        at_risk_accounts(t, as_of, days)
        .join(spend, F.col("id") == F.col("spender_id"), "left")
        .agg(
            F.round(F.sum(F.coalesce("annual_spend", F.lit(0.0))), 2).alias("revenue_at_risk")
        )
    )
