"""The business data model: table schemas, keys and closed value sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_STRING, _DATE = T.StringType(), T.DateType()


def _schema(*columns: tuple) -> T.StructType:
    """Each column is (name, type) or (name, type, True) for a nullable one."""
    return T.StructType(
        [T.StructField(c[0], c[1], len(c) > 2 and c[2]) for c in columns]
    )


SCHEMAS: dict[str, T.StructType] = {
    "account_managers": _schema(
        ("id", _LONG), ("name", _STRING), ("email", _STRING), ("region", _STRING)
    ),
    "customers": _schema(
        ("id", _LONG), ("name", _STRING), ("country", _STRING), ("segment", _STRING),
        ("account_manager_id", _LONG, True), ("acquisition_date", _DATE),
        ("status", _STRING),
    ),
    "products": _schema(
        ("id", _LONG), ("name", _STRING), ("category", _STRING),
        ("list_price", _DOUBLE), ("product_type", _STRING),
    ),
    "machines": _schema(
        ("id", _LONG), ("customer_id", _LONG, True), ("product_id", _LONG, True),
        ("serial_number", _STRING), ("installation_date", _DATE), ("status", _STRING),
    ),
    "service_contracts": _schema(
        ("id", _LONG), ("customer_id", _LONG, True), ("machine_id", _LONG, True),
        ("start_date", _DATE), ("end_date", _DATE), ("annual_value", _DOUBLE),
        ("status", _STRING),
    ),
    "orders": _schema(
        ("id", _LONG), ("customer_id", _LONG, True), ("account_manager_id", _LONG, True),
        ("order_date", _DATE), ("total_value", _DOUBLE), ("status", _STRING),
    ),
    "order_lines": _schema(
        ("id", _LONG), ("order_id", _LONG, True), ("product_id", _LONG, True),
        ("quantity", _INT), ("unit_price", _DOUBLE), ("line_value", _DOUBLE),
    ),
    "quotes": _schema(
        ("id", _LONG), ("customer_id", _LONG, True), ("account_manager_id", _LONG, True),
        ("created_date", _DATE), ("sent_date", _DATE, True), ("expiry_date", _DATE, True),
        ("total_value", _DOUBLE), ("status", _STRING),
    ),
    "quote_lines": _schema(
        ("id", _LONG), ("quote_id", _LONG, True), ("product_id", _LONG, True),
        ("quantity", _INT), ("unit_price", _DOUBLE),
    ),
}

# The closed sets each status or type column may hold.
ALLOWED_VALUES: dict[tuple[str, str], tuple[str, ...]] = {
    ("customers", "segment"): ("enterprise", "mid_market", "smb"),
    ("customers", "status"): ("active", "inactive", "churned"),
    ("products", "product_type"): ("equipment", "spare_part", "service_package"),
    ("machines", "status"): ("active", "decommissioned"),
    ("service_contracts", "status"): ("active", "expired", "cancelled"),
    ("orders", "status"): ("pending", "completed", "cancelled"),
    ("quotes", "status"): ("draft", "sent", "won", "lost", "expired"),
}

UNIQUE_KEYS: tuple[tuple[str, str], ...] = tuple(
    (table, "id") for table in SCHEMAS
) + (("machines", "serial_number"),)

# (child table, child column, parent table); the parent column is always id.
FOREIGN_KEYS: tuple[tuple[str, str, str], ...] = (
    ("customers", "account_manager_id", "account_managers"),
    ("machines", "customer_id", "customers"),
    ("machines", "product_id", "products"),
    ("service_contracts", "customer_id", "customers"),
    ("service_contracts", "machine_id", "machines"),
    ("orders", "customer_id", "customers"),
    ("orders", "account_manager_id", "account_managers"),
    ("order_lines", "order_id", "orders"),
    ("order_lines", "product_id", "products"),
    ("quotes", "customer_id", "customers"),
    ("quotes", "account_manager_id", "account_managers"),
    ("quote_lines", "quote_id", "quotes"),
    ("quote_lines", "product_id", "products"),
)

# (header table, line table, line column naming the header, line amount, header total)
DERIVED_TOTALS: tuple[tuple[str, str, str, str, str], ...] = (
    ("orders", "order_lines", "order_id", "quantity * unit_price", "total_value"),
    ("quotes", "quote_lines", "quote_id", "quantity * unit_price", "total_value"),
)


class Tables:
    """The tables every report reads, by name as attributes.

    A table may be given as a function of no arguments, which is called when the table
    is first used.  quote_lines feeds no report and may be absent.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        unknown = set(tables) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._given = dict(tables)

    def __getattr__(self, name: str) -> DataFrame:
        given = self.__dict__.get("_given", {})
        if name not in given:
            raise AttributeError(f"no table {name}")
        if not isinstance(given[name], DataFrame):
            given[name] = given[name]()
        return given[name]

    def names(self) -> list[str]:
        return [name for name in SCHEMAS if name in self._given]

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in self.names()]
