"""The fifty business reports.

Each takes the tables and the date it is seen from, and returns the columns of the
report in its display order.  Where the display order is not unique, the row's key
decides, so that ties neither depend on the run nor fall into one sort range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions.dates import (
    days_before,
    in_year,
    month_label,
    quarter_label,
)
from fleetlens.functions.numbers import ratio
from fleetlens.model import Tables
from fleetlens.operators.ranking import global_rank, latest_per_key
from fleetlens.plans import definitions as d
from fleetlens.plans.definitions import distinct_keys, with_status

Report = Callable[..., DataFrame]


def _names(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("id", "name", *columns)


# --- Evaluation reports -------------------------------------------------------------


def at_risk_accounts(t: Tables, as_of: date, days: int = 180) -> DataFrame:
    return d.at_risk_accounts(t, as_of, days).select("id", "name", "country", "last_order_date")


def stale_quotes(t: Tables, as_of: date, days: int = 45) -> DataFrame:
    buyers = t.customers.select(F.col("id").alias("buyer_id"), F.col("name").alias("customer_name"))
    return (
        d.stale_quotes(t, as_of, days)
        .join(buyers, F.col("customer_id") == F.col("buyer_id"))
        .orderBy("sent_date", "id")
        .select("id", "customer_name", "sent_date", "total_value")
    )


def cross_sell_candidates(t: Tables, as_of: date) -> DataFrame:
    return d.cross_sell_candidates(t).orderBy(F.desc("active_machines"), "id")


def revenue_this_year(t: Tables, as_of: date) -> DataFrame:
    revenue = (
        with_status(t.orders, "completed")
        .filter(in_year("order_date", as_of.year))
        .groupBy("customer_id")
        .agg(F.sum("total_value").alias("revenue_ytd"))
    )
    return (
        _names(t.customers)
        .join(revenue, F.col("id") == F.col("customer_id"))
        .orderBy(F.desc("revenue_ytd"), "id")
        .select("name", "revenue_ytd")
    )


def products_not_ordered(t: Tables, as_of: date, months: int = 6) -> DataFrame:
    recent = with_status(t.orders, "completed").filter(
        F.col("order_date") >= F.lit(d.months_before(as_of, months))
    )
    bought = distinct_keys(
        t.order_lines.join(
            recent.select(F.col("id").alias("recent_id")),
            F.col("order_id") == F.col("recent_id"),
            "left_semi",
        ),
        "product_id",
        "bought_id",
    )
    return (
        t.products.join(bought, F.col("id") == F.col("bought_id"), "left_anti")
        .orderBy("name", "id")
        .select("id", "name", "product_type")
    )


def high_value_accounts(t: Tables, as_of: date, tiles: int = 5) -> DataFrame:
    return (
        _names(t.customers)
        .join(d.high_value_accounts(t, tiles), F.col("id") == F.col("customer_id"))
        .orderBy(F.desc("lifetime_value"), "id")
        .select("name", "lifetime_value")
    )


def active_machines_per_customer(t: Tables, as_of: date) -> DataFrame:
    return (
        _names(t.customers)
        .join(d.active_machine_counts(t), F.col("id") == F.col("owner_id"), "left")
        .select("id", "name", F.coalesce("active_machines", F.lit(0)).alias("active_machines"))
        .orderBy(F.desc("active_machines"), "id")
        .select("name", "active_machines")
    )


def contract_penetration(t: Tables, as_of: date) -> DataFrame:
    return (
        _names(t.customers)
        .join(d.service_penetration(t), F.col("id") == F.col("owner_id"))
        .orderBy(F.asc_nulls_first("penetration_pct"), "id")
        .select("name", "total_machines", "contracted_machines", "penetration_pct")
    )


def churn_signal(t: Tables, as_of: date, months: int = 6) -> DataFrame:
    return (
        d.churn_signal(t, as_of, months)
        .orderBy((F.col("prior") - F.col("recent")).desc(), "id")
        .select("name", "recent", "prior")
    )


def expansion_potential(t: Tables, as_of: date) -> DataFrame:
    return (
        _names(t.customers)
        .join(d.expansion_potential(t), F.col("id") == F.col("owner_id"))
        .orderBy(F.desc("expansion_potential"), "id")
        .select("name", "total_machines", "expansion_potential")
    )


def pipeline_by_manager(t: Tables, as_of: date) -> DataFrame:
    open_quotes = (
        with_status(t.quotes, "draft", "sent")
        .groupBy("account_manager_id")
        .agg(F.count("id").alias("open_quotes"), F.sum("total_value").alias("pipeline_value"))
    )
    return (
        _names(t.account_managers)
        .join(open_quotes, F.col("id") == F.col("account_manager_id"))
        .orderBy(F.desc("pipeline_value"), "id")
        .select("name", "open_quotes", "pipeline_value")
    )


def equipment_without_spare_parts(t: Tables, as_of: date) -> DataFrame:
    """One pass over the lines: which of the two kinds each order, then each customer,
    has bought."""
    kinds = t.products.filter(F.col("product_type").isin("equipment", "spare_part")).select(
        F.col("id").alias("kind_id"), "product_type"
    )
    per_order = (
        t.order_lines.join(kinds, F.col("product_id") == F.col("kind_id"))
        .groupBy("order_id")
        .agg(
            F.max(F.col("product_type") == "equipment").alias("equipment"),
            F.max(F.col("product_type") == "spare_part").alias("spare_part"),
        )
    )
    per_customer = (
        with_status(t.orders, "completed")
        .join(per_order, F.col("id") == F.col("order_id"))
        .groupBy("customer_id")
        .agg(F.max("equipment").alias("equipment"), F.max("spare_part").alias("spare_part"))
        .filter(F.col("equipment") & ~F.col("spare_part"))
    )
    return _names(t.customers).join(
        per_customer, F.col("id") == F.col("customer_id"), "left_semi"
    )


def revenue_at_risk(t: Tables, as_of: date) -> DataFrame:
    return d.revenue_at_risk(t, as_of)


def quote_win_rate(t: Tables, as_of: date) -> DataFrame:
    closed = (
        with_status(t.quotes, "won", "lost")
        .groupBy("account_manager_id")
        .agg(
            F.count(F.lit(1)).alias("total_closed"),
            F.count_if(F.col("status") == "won").alias("won"),
        )
        .withColumn(
            "win_rate_pct", F.round(ratio(F.col("won"), F.col("total_closed")) * 100, 1)
        )
    )
    return (
        _names(t.account_managers)
        .join(closed, F.col("id") == F.col("account_manager_id"))
        .orderBy(F.desc("win_rate_pct"), "id")
        .select("name", "total_closed", "won", "win_rate_pct")
    )


def at_risk_installed_base(t: Tables, as_of: date, days: int = 180) -> DataFrame:
    prices = t.products.select(F.col("id").alias("priced_id"), "list_price")
    base = (
        with_status(t.machines, "active")
        .join(prices, F.col("product_id") == F.col("priced_id"))
        .groupBy("customer_id")
        .agg(F.count("id").alias("machines"), F.sum("list_price").alias("installed_base_value"))
    )
    return (
        d.at_risk_accounts(t, as_of, days)
        .join(base, F.col("id") == F.col("customer_id"))
        .orderBy(F.desc("installed_base_value"), "id")
        .select(
            "name",
            F.col("last_order_date").alias("last_order"),
            "machines",
            "installed_base_value",
        )
    )


def uncontracted_value(t: Tables, as_of: date) -> DataFrame:
    prices = t.products.select(F.col("id").alias("priced_id"), "list_price")
    coverage = d.machine_coverage(t).join(prices, F.col("product_id") == F.col("priced_id"))
    open_value = F.sum(
        F.when(F.col("contracts") == 0, F.col("list_price")).otherwise(F.lit(0.0))
    )
    totals = (
        d.coverage_totals(coverage, open_value.alias("uncontracted_base_value"))
        .withColumn("uncontracted", F.col("total_machines") - F.col("contracted_machines"))
        .filter(F.col("uncontracted") > 0)
    )
    return (
        _names(t.customers)
        .join(totals, F.col("id") == F.col("owner_id"))
        .orderBy(F.desc("uncontracted_base_value"), "id")
        .select(
            "name",
            "total_machines",
            F.col("contracted_machines").alias("contracted"),
            "uncontracted",
            "uncontracted_base_value",
        )
    )


def _orders_with(t: Tables, product_type: str) -> DataFrame:
    """order_with: ids of orders holding at least one line of the product type."""
    wanted = t.products.filter(F.col("product_type") == product_type).select(
        F.col("id").alias("wanted_id")
    )
    return distinct_keys(
        t.order_lines.join(wanted, F.col("product_id") == F.col("wanted_id"), "left_semi"),
        "order_id",
        "order_with",
    )


def days_to_first_spare_part(t: Tables, as_of: date) -> DataFrame:
    """Uses each customer's first spare-part order of all time; machines installed on
    or after that day are left out."""
    first_spare = (
        with_status(t.orders, "completed")
        .join(_orders_with(t, "spare_part"), F.col("id") == F.col("order_with"), "left_semi")
        .groupBy(F.col("customer_id").alias("buyer_id"))
        .agg(F.min("order_date").alias("first_spare_date"))
    )
    per_product = (
        t.machines.join(
            first_spare,
            (F.col("customer_id") == F.col("buyer_id"))
            & (F.col("first_spare_date") > F.col("installation_date")),
        )
        .groupBy("product_id")
        .agg(F.avg(F.datediff("first_spare_date", "installation_date")).alias("mean_days"))
    )
    return (
        _names(t.products)
        .join(per_product, F.col("id") == F.col("product_id"))
        .select("id", "name", F.round("mean_days", 0).alias("avg_days_to_first_spare"))
        .orderBy("avg_days_to_first_spare", "id")
        .select("name", "avg_days_to_first_spare")
    )


def declining_frequency(
    t: Tables, as_of: date, statuses: Sequence[str] = ("completed",)
) -> DataFrame:
    """Two falls over three present quarters; quarters without orders are skipped."""
    quarterly = (
        with_status(t.orders, *statuses)
        .groupBy("customer_id", quarter_label("order_date").alias("quarter"))
        .agg(F.count(F.lit(1)).alias("order_count"))
    )
    # One row per customer and calendar quarter, so no window partition grows with the
    # number of orders.
    over = W.partitionBy("customer_id").orderBy("quarter")
    falling = (
        quarterly.withColumn("prev1", F.lag("order_count", 1).over(over))
        .withColumn("prev2", F.lag("order_count", 2).over(over))
        .filter((F.col("order_count") < F.col("prev1")) & (F.col("prev1") < F.col("prev2")))
    )
    return (
        t.customers.join(falling, F.col("id") == F.col("customer_id"), "left_semi")
        .select("name")
        .distinct()
    )


def manager_summary(
    t: Tables, as_of: date, risk_days: int = 180, stale_days: int = 45
) -> DataFrame:
    at_risk = (
        d.at_risk_accounts(t, as_of, risk_days)
        .groupBy(F.col("account_manager_id").alias("risk_manager"))
        .agg(F.count(F.lit(1)).alias("at_risk_accounts"))
    )
    stale = (F.col("status") == "sent") & (
        F.col("sent_date") < F.lit(days_before(as_of, stale_days))
    )
    pipeline = (
        with_status(t.quotes, "draft", "sent")
        .groupBy(F.col("account_manager_id").alias("quote_manager"))
        .agg(
            F.count_if(stale).alias("stale_quotes"),
            F.sum("total_value").alias("pipeline_value"),
        )
    )
    return (
        _names(t.account_managers)
        .join(at_risk, F.col("id") == F.col("risk_manager"), "left")
        .join(pipeline, F.col("id") == F.col("quote_manager"), "left")
        .select(
            "id",
            "name",
            F.coalesce("at_risk_accounts", F.lit(0)).alias("at_risk_accounts"),
            F.coalesce("stale_quotes", F.lit(0)).alias("stale_quotes"),
            F.coalesce("pipeline_value", F.lit(0.0)).alias("pipeline_value"),
        )
        .orderBy(F.desc("at_risk_accounts"), "id")
        .drop("id")
    )


def account_health(
    t: Tables, as_of: date, risk_days: int = 180, stale_days: int = 45, months: int = 6
) -> DataFrame:
    middle = F.lit(d.months_before(as_of, months))
    start = F.lit(d.months_before(as_of, 2 * months))
    when = F.col("order_date")
    ordering = (
        with_status(t.orders, "completed")
        .groupBy(F.col("customer_id").alias("buyer_id"))
        .agg(
            F.max(when).alias("last_order_date"),
            F.count_if(when >= middle).alias("recent"),
            F.count_if((when >= start) & (when < middle)).alias("prior"),
        )
    )
    quoted = distinct_keys(d.stale_quotes(t, as_of, stale_days), "customer_id", "quoted_id")
    signals = (
        with_status(t.customers, "active")
        .join(ordering, F.col("id") == F.col("buyer_id"), "left")
        .join(quoted, F.col("id") == F.col("quoted_id"), "left")
        .select(
            "id",
            "name",
            "segment",
            (
                (
                    F.col("last_order_date").isNull()
                    | (F.col("last_order_date") < F.lit(days_before(as_of, risk_days)))
                ).cast("int")
                + F.col("quoted_id").isNotNull().cast("int")
                + F.coalesce(F.col("recent") < F.col("prior"), F.lit(False)).cast("int")
            ).alias("signal_count"),
        )
    )
    return (
        signals.withColumn(
            "health_status",
            F.when(F.col("signal_count") == 0, "healthy")
            .when(F.col("signal_count") == 1, "watch")
            .otherwise("at-risk"),
        )
        .orderBy(F.desc("signal_count"), "name", "id")
        .drop("id")
    )


# --- Training reports ---------------------------------------------------------------


def active_customers(t: Tables, as_of: date) -> DataFrame:
    return with_status(t.customers, "active").orderBy("name", "id").select("name", "country")


def orders_per_status(t: Tables, as_of: date) -> DataFrame:
    counts = t.orders.groupBy("status").agg(F.count(F.lit(1)).alias("order_count"))
    return counts.orderBy(F.desc("order_count"), "status")


def mean_price_per_type(t: Tables, as_of: date) -> DataFrame:
    means = t.products.groupBy("product_type").agg(
        F.round(F.avg("list_price"), 2).alias("avg_price")
    )
    return means.orderBy(F.desc("avg_price"), "product_type")


def equipment_by_price(t: Tables, as_of: date) -> DataFrame:
    return (
        t.products.filter(F.col("product_type") == "equipment")
        .orderBy(F.desc("list_price"), "id")
        .select("name", "category", "list_price")
    )


def managers_in_region(t: Tables, as_of: date, region: str = "EMEA") -> DataFrame:
    return (
        t.account_managers.filter(F.col("region") == region)
        .orderBy("name", "id")
        .select("name", "email")
    )


def customers_per_segment(t: Tables, as_of: date) -> DataFrame:
    counts = (
        with_status(t.customers, "active")
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("customer_count"))
    )
    return counts.orderBy(F.desc("customer_count"), "segment")


def decommissioned_machines(t: Tables, as_of: date) -> DataFrame:
    owners = t.customers.select(F.col("id").alias("owner_id"), F.col("name").alias("customer_name"))
    return (
        with_status(t.machines, "decommissioned")
        .join(owners, F.col("customer_id") == F.col("owner_id"))
        .orderBy("installation_date", "id")
        .select("serial_number", "customer_name", "installation_date")
    )


def completed_revenue(t: Tables, as_of: date) -> DataFrame:
    return with_status(t.orders, "completed").agg(
        F.round(F.sum("total_value"), 2).alias("total_completed_revenue")
    )


def customers_acquired(t: Tables, as_of: date, year: int | None = None) -> DataFrame:
    return (
        t.customers.filter(in_year("acquisition_date", as_of.year - 3 if year is None else year))
        .orderBy("acquisition_date", "id")
        .select("name", "country", "acquisition_date")
    )


def expired_contracts(t: Tables, as_of: date) -> DataFrame:
    owners = t.customers.select(F.col("id").alias("owner_id"), F.col("name").alias("customer_name"))
    units = t.machines.select(F.col("id").alias("unit_id"), "serial_number")
    return (
        with_status(t.service_contracts, "expired")
        .join(units, F.col("machine_id") == F.col("unit_id"))
        .join(owners, F.col("customer_id") == F.col("owner_id"))
        .orderBy("end_date", "id")
        .select("customer_name", "serial_number", "start_date", "end_date", "annual_value")
    )


def product_order_frequency(t: Tables, as_of: date) -> DataFrame:
    times = t.order_lines.groupBy("product_id").agg(F.count("id").alias("times_ordered"))
    return (
        _names(t.products)
        .join(times, F.col("id") == F.col("product_id"))
        .orderBy(F.desc("times_ordered"), "id")
        .select("name", "times_ordered")
    )


def quotes_per_status(t: Tables, as_of: date) -> DataFrame:
    counts = t.quotes.groupBy("status").agg(F.count(F.lit(1)).alias("quote_count"))
    return counts.orderBy(F.desc("quote_count"), "status")


def many_active_machines(t: Tables, as_of: date, more_than: int = 2) -> DataFrame:
    counts = d.active_machine_counts(t).filter(F.col("active_machines") > more_than)
    return (
        _names(t.customers)
        .join(counts, F.col("id") == F.col("owner_id"))
        .orderBy(F.desc("active_machines"), "id")
        .select("name", "active_machines")
    )


def order_value_by_manager(t: Tables, as_of: date) -> DataFrame:
    totals = (
        with_status(t.orders, "completed")
        .groupBy("account_manager_id")
        .agg(
            F.count("id").alias("total_orders"),
            F.round(F.sum("total_value"), 2).alias("total_revenue"),
        )
    )
    return (
        _names(t.account_managers)
        .join(totals, F.col("id") == F.col("account_manager_id"))
        .orderBy(F.desc("total_revenue"), "id")
        .select("name", "total_orders", "total_revenue")
    )


def mean_order_value_per_segment(t: Tables, as_of: date) -> DataFrame:
    per_customer = (
        with_status(t.orders, "completed")
        .groupBy("customer_id")
        .agg(F.sum("total_value").alias("value"), F.count("total_value").alias("n"))
    )
    return (
        t.customers.select("id", "segment")
        .join(per_customer, F.col("id") == F.col("customer_id"))
        .groupBy("segment")
        .agg(F.round(ratio(F.sum("value"), F.sum("n")), 2).alias("avg_order_value"))
        .orderBy(F.desc("avg_order_value"), "segment")
    )


def partly_contracted_customers(t: Tables, as_of: date) -> DataFrame:
    """Counts machines, not contracts: coverage holds one row per machine, so no
    distinct count is needed."""
    counts = (
        d.machine_coverage(t)
        .groupBy("owner_id")
        .agg(
            F.count_if(F.col("contracts") > 0).alias("contracted_machines"),
            F.count_if(F.col("contracts") == 0).alias("uncontracted_machines"),
        )
        .filter((F.col("contracted_machines") > 0) & (F.col("uncontracted_machines") > 0))
    )
    return (
        _names(t.customers)
        .join(counts, F.col("id") == F.col("owner_id"))
        .orderBy(F.desc("uncontracted_machines"), "id")
        .select("name", "contracted_machines", "uncontracted_machines")
    )


def contract_value_per_customer(t: Tables, as_of: date) -> DataFrame:
    value = (
        with_status(t.service_contracts, "active")
        .groupBy("customer_id")
        .agg(F.sum("annual_value").alias("total_contract_value"))
    )
    return (
        _names(t.customers)
        .join(value, F.col("id") == F.col("customer_id"))
        .orderBy(F.desc("total_contract_value"), "id")
        .select("name", "total_contract_value")
    )


def latest_order_was_spare_part(t: Tables, as_of: date) -> DataFrame:
    latest = latest_per_key(
        with_status(t.orders, "completed").select(
            F.col("id").alias("latest_id"), "customer_id", "order_date"
        ),
        "customer_id",
        [F.desc("order_date"), F.asc("latest_id")],
    )
    return (
        latest.join(
            _orders_with(t, "spare_part"), F.col("latest_id") == F.col("order_with"), "left_semi"
        )
        .join(_names(t.customers), F.col("id") == F.col("customer_id"))
        .orderBy(F.desc("order_date"), "id")
        .select("name", "order_date")
    )


def orders_per_month(t: Tables, as_of: date, year: int | None = None) -> DataFrame:
    return (
        with_status(t.orders, "completed")
        .filter(in_year("order_date", as_of.year - 1 if year is None else year))
        .groupBy(month_label("order_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy("month")
    )


def managers_in_many_countries(t: Tables, as_of: date, more_than: int = 1) -> DataFrame:
    counts = (
        with_status(t.customers, "active")
        .groupBy("account_manager_id")
        .agg(F.count_distinct("country").alias("countries"))
        .filter(F.col("countries") > more_than)
    )
    return (
        _names(t.account_managers)
        .join(counts, F.col("id") == F.col("account_manager_id"))
        .orderBy(F.desc("countries"), "id")
        .select("name", "countries")
    )


def top_line_per_order(t: Tables, as_of: date) -> DataFrame:
    """Ties are kept.  The join back is on order and value together, so one order with
    very many lines still spreads over tasks."""
    best = t.order_lines.groupBy(F.col("order_id").alias("best_order")).agg(
        F.max("line_value").alias("best_value")
    )
    buyers = t.customers.select(F.col("id").alias("buyer_id"), F.col("name").alias("customer_name"))
    goods = t.products.select(F.col("id").alias("goods_id"), F.col("name").alias("product_name"))
    headers = t.orders.select(F.col("id").alias("header_id"), "customer_id")
    return (
        t.order_lines.join(
            best,
            (F.col("order_id") == F.col("best_order"))
            & (F.col("line_value") == F.col("best_value")),
        )
        .join(headers, F.col("order_id") == F.col("header_id"))
        .join(buyers, F.col("customer_id") == F.col("buyer_id"))
        .join(goods, F.col("product_id") == F.col("goods_id"))
        .orderBy(F.desc("line_value"), "order_id", "goods_id")
        .select("order_id", "customer_name", "product_name", "line_value")
    )


def machines_without_recent_orders(
    t: Tables, as_of: date, years: Sequence[int] | None = None
) -> DataFrame:
    wanted = (as_of.year - 1, as_of.year) if years is None else tuple(years)
    in_years = F.lit(False)
    for year in wanted:
        in_years = in_years | in_year("order_date", year)
    buyers = distinct_keys(
        with_status(t.orders, "completed").filter(in_years), "customer_id", "buyer_id"
    )
    return (
        with_status(t.customers, "active")
        .join(buyers, F.col("id") == F.col("buyer_id"), "left_anti")
        .join(d.active_machine_counts(t), F.col("id") == F.col("owner_id"))
        .orderBy(F.desc("active_machines"), "id")
        .select("name", "active_machines")
    )


def lifetime_spend_rank(t: Tables, as_of: date) -> DataFrame:
    ranked = global_rank(d.lifetime_value(t), "lifetime_value", "customer_id", "spend_rank")
    return (
        _names(t.customers)
        .join(ranked, F.col("id") == F.col("customer_id"))
        .orderBy("spend_rank", "id")
        .select("name", F.round("lifetime_value", 2).alias("lifetime_spend"), "spend_rank")
    )


def buyers_per_category(t: Tables, as_of: date) -> DataFrame:
    goods = t.products.select(F.col("id").alias("goods_id"), "category")
    completed = with_status(t.orders, "completed").select(
        F.col("id").alias("header_id"), "customer_id"
    )
    return (
        t.order_lines.join(completed, F.col("order_id") == F.col("header_id"))
        .join(goods, F.col("product_id") == F.col("goods_id"))
        .groupBy("category")
        .agg(F.count_distinct("customer_id").alias("distinct_customers"))
        .orderBy(F.desc("distinct_customers"), "category")
    )


def first_and_last_order(t: Tables, as_of: date) -> DataFrame:
    spans = (
        with_status(t.orders, "completed")
        .groupBy("customer_id")
        .agg(
            F.min("order_date").alias("first_order"),
            F.max("order_date").alias("last_order"),
            F.count("id").alias("n"),
        )
        .filter(F.col("n") > 1)
        .withColumn("days_span", F.datediff("last_order", "first_order"))
    )
    return (
        _names(t.customers)
        .join(spans, F.col("id") == F.col("customer_id"))
        .orderBy(F.desc("days_span"), "id")
        .select("name", "first_order", "last_order", "days_span")
    )


def machines_from_many_categories(t: Tables, as_of: date, at_least: int = 3) -> DataFrame:
    goods = t.products.select(F.col("id").alias("goods_id"), "category")
    counts = (
        with_status(t.machines, "active")
        .join(goods, F.col("product_id") == F.col("goods_id"))
        .groupBy("customer_id")
        .agg(F.count_distinct("category").alias("machine_categories"))
        .filter(F.col("machine_categories") >= at_least)
    )
    return (
        _names(t.customers)
        .join(counts, F.col("id") == F.col("customer_id"))
        .orderBy(F.desc("machine_categories"), "id")
        .select("name", "machine_categories")
    )


def running_revenue(t: Tables, as_of: date) -> DataFrame:
    """The unpartitioned window sees one row per calendar month."""
    monthly = (
        with_status(t.orders, "completed")
        .groupBy(month_label("order_date").alias("month"))
        .agg(F.sum("total_value").alias("revenue"))
    )
    so_far = W.orderBy("month").rangeBetween(W.unboundedPreceding, W.currentRow)
    return monthly.select(
        "month",
        F.round("revenue", 2).alias("monthly_revenue"),
        F.round(F.sum("revenue").over(so_far), 2).alias("running_total"),
    ).orderBy("month")


def manager_workload(t: Tables, as_of: date) -> DataFrame:
    """Both counts come from one pass over active customers."""
    per_manager = (
        with_status(t.customers, "active")
        .select("id", "account_manager_id")
        .join(d.active_machine_counts(t), F.col("id") == F.col("owner_id"), "left")
        .groupBy("account_manager_id")
        .agg(F.count("id").alias("n_customers"), F.sum("active_machines").alias("n_machines"))
    )
    return (
        _names(t.account_managers)
        .join(per_manager, F.col("id") == F.col("account_manager_id"), "left")
        .select(
            "id",
            "name",
            F.coalesce("n_customers", F.lit(0)).alias("customers"),
            F.coalesce("n_machines", F.lit(0)).alias("active_machines"),
        )
        .orderBy(F.desc("customers"), "id")
        .drop("id")
    )


def sales_per_product_type(t: Tables, as_of: date) -> DataFrame:
    goods = t.products.select(F.col("id").alias("goods_id"), "product_type")
    completed = with_status(t.orders, "completed").select(
        F.col("id").alias("header_id"), "customer_id"
    )
    return (
        t.order_lines.join(completed, F.col("order_id") == F.col("header_id"))
        .join(goods, F.col("product_id") == F.col("goods_id"))
        # One row per type and buyer first, so that no line is kept twice for the distinct count.
        .groupBy("product_type", "customer_id")
        .agg(F.sum("quantity").alias("quantity"), F.sum("line_value").alias("line_value"))
        .groupBy("product_type")
        .agg(
            F.sum("quantity").alias("total_quantity"),
            F.round(F.sum("line_value"), 2).alias("total_revenue"),
            F.count("customer_id").alias("distinct_buyers"),
        )
        .orderBy(F.desc("total_revenue"), "product_type")
    )


def mean_machines_per_segment(t: Tables, as_of: date) -> DataFrame:
    return (
        with_status(t.customers, "active")
        .select("id", "segment")
        .join(d.active_machine_counts(t), F.col("id") == F.col("owner_id"), "left")
        .groupBy("segment")
        .agg(
            F.round(F.avg(F.coalesce("active_machines", F.lit(0))), 1).alias(
                "avg_machines_per_customer"
            )
        )
        .orderBy(F.desc("avg_machines_per_customer"), "segment")
    )


EVAL_REPORTS: dict[int, Report] = dict(
    enumerate(
        (
            at_risk_accounts,
            stale_quotes,
            cross_sell_candidates,
            revenue_this_year,
            products_not_ordered,
            high_value_accounts,
            active_machines_per_customer,
            contract_penetration,
            churn_signal,
            expansion_potential,
            pipeline_by_manager,
            equipment_without_spare_parts,
            revenue_at_risk,
            quote_win_rate,
            at_risk_installed_base,
            uncontracted_value,
            days_to_first_spare_part,
            declining_frequency,
            manager_summary,
            account_health,
        ),
        1,
    )
)

TRAINING_REPORTS: dict[int, Report] = dict(
    enumerate(
        (
            active_customers,
            orders_per_status,
            mean_price_per_type,
            equipment_by_price,
            managers_in_region,
            customers_per_segment,
            decommissioned_machines,
            completed_revenue,
            customers_acquired,
            expired_contracts,
            product_order_frequency,
            quotes_per_status,
            many_active_machines,
            order_value_by_manager,
            mean_order_value_per_segment,
            partly_contracted_customers,
            contract_value_per_customer,
            latest_order_was_spare_part,
            orders_per_month,
            managers_in_many_countries,
            top_line_per_order,
            machines_without_recent_orders,
            lifetime_spend_rank,
            buyers_per_category,
            first_and_last_order,
            machines_from_many_categories,
            running_revenue,
            manager_workload,
            sales_per_product_type,
            mean_machines_per_segment,
        ),
        1,
    )
)
