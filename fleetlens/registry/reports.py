"""The fifty reports as named queries over the warehouse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans import reports
from fleetlens.plans.catalogue import EVAL, ansi_days, catalogue
from fleetlens.sources.binding import AS_OF, bind, with_binding

Query = Callable[[SparkSession, str], DataFrame]

# Parameters under which the warehouse has rows for every report.
REGION = "EUROPE"
ACQUIRED_YEAR = 1996
FREQUENCY_STATUSES = ("completed", "pending", "cancelled")
_PARAMETERS: dict[str, dict] = {
    "managers_in_region": {"region": REGION},
    "customers_acquired": {"year": ACQUIRED_YEAR},
    "declining_frequency": {"statuses": FREQUENCY_STATUSES},
}
# Sums of doubles depend on the order of addition, so both forms round them.
_UNROUNDED_SUMS: dict[str, Sequence[str]] = {
    "revenue_this_year": ["revenue_ytd"],
    "high_value_accounts": ["lifetime_value"],
    "pipeline_by_manager": ["pipeline_value"],
    "at_risk_installed_base": ["installed_base_value"],
    "uncontracted_value": ["uncontracted_base_value"],
    "manager_summary": ["pipeline_value"],
    "contract_value_per_customer": ["total_contract_value"],
    "sales_per_product_type": ["total_quantity"],
    "expired_contracts": ["annual_value"],
}


def rounded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in columns})


def rounded_sql(sql: str, columns: Sequence[str]) -> str:
    if not columns:
        return sql
    replaced = ", ".join(f"ROUND({c}, 2) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM (\n{sql}\n) AS unrounded"


def _report_query(report: reports.Report) -> Query:
    name = report.__name__
    parameters = _PARAMETERS.get(name, {})

    def run(spark: SparkSession, directory: str) -> DataFrame:
        df = report(bind(spark, directory), AS_OF, **parameters)
        return rounded(df, _UNROUNDED_SUMS.get(name, ()))

    return run


def _reports() -> dict[str, reports.Report]:
    named = {f"q{n:02d}_{r.__name__}": r for n, r in reports.EVAL_REPORTS.items()}
    named.update({f"t{n:02d}_{r.__name__}": r for n, r in reports.TRAINING_REPORTS.items()})
    return named


def warehouse_catalogue(days=ansi_days):
    return catalogue(
        AS_OF,
        region=REGION,
        acquired_year=ACQUIRED_YEAR,
        frequency_statuses=FREQUENCY_STATUSES,
        days=days,
    )


def _report_sql() -> dict[str, str]:
    texts = {
        ("q" if e.split == EVAL else "t") + f"{e.query_id:02d}": e.sql
        for e in warehouse_catalogue()
    }
    return {
        key: with_binding(
            rounded_sql(texts[key[:3]], _UNROUNDED_SUMS.get(report.__name__, ()))
        )
        for key, report in _reports().items()
    }


def queries() -> dict[str, Query]:
    return {key: _report_query(report) for key, report in _reports().items()}


def oracle_sql() -> dict[str, str]:
    return _report_sql()
