"""Every report and operator as a named query over the warehouse tables.

`queries()` gives the Spark form and `oracle_sql()` the same result in plain SQL, over
the whole tables in both cases.
"""

from __future__ import annotations

from fleetlens.registry import operators, reports
from fleetlens.registry.reports import Query


def queries() -> dict[str, Query]:
    return {**reports.queries(), **operators.queries()}


def oracle_sql() -> dict[str, str]:
    return {**reports.oracle_sql(), **operators.oracle_sql()}
