"""Business tables seen through an order-and-events warehouse.

The warehouse holds customer, supplier, part, orders, lineitem, events, nation and
region.  `bind` derives the business tables from it as lazy DataFrames, and
`BINDING_SQL` says the same in SQL so that a result can be checked elsewhere.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date
from functools import cache, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.model import Tables
from fleetlens.sources.checkpoints import checkpoint_dir

# The date at which the warehouse is looked at, and the first day on
# which a quote may have been created or sent.
AS_OF = date(2001, 8, 1)
QUOTE_CREATED_FROM = date(2001, 6, 1)
QUOTE_SENT_FROM = date(2001, 6, 3)

# How codes of the warehouse map to the closed sets of the model.
EQUIPMENT_TYPES = ("ECONOMY", "STANDARD", "PROMO")
SPARE_PART_TYPES = ("SMALL", "MEDIUM")
ENTERPRISE_SEGMENTS = ("MACHINERY", "BUILDING")
MID_MARKET_SEGMENTS = ("FURNITURE", "AUTOMOBILE")
URGENT = "1-URGENT"
MANAGERS = 10
CONTRACT_DAYS = 365
CONTRACT_RATE = 0.1


@lru_cache(maxsize=256)
def _stored_schema(path: str) -> str:
    return SparkSession.active().read.parquet(path).schema.json()


def read_warehouse(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A warehouse table.  Its schema is read from the files once per process, which
    saves a footer job each time the table is opened."""
    path = f"{directory}/{name}.parquet"
    schema = T.StructType.fromJson(json.loads(_stored_schema(path)))
    return spark.read.schema(schema).parquet(path)


#: Takes a session, a name and what it stands for; returns the same rows in that session.
Kept = Callable[[SparkSession, str, DataFrame], DataFrame]


def bind_once(spark: SparkSession, directory: str) -> Callable[[SparkSession], Tables]:
    """The business tables in any session, for many queries over the same warehouse.

    What takes joins of large tables is derived and written by the first session that binds,
    and read from there by it and by all others."""
    folder = f"{checkpoint_dir(spark)}/bound-{uuid.uuid4().hex}"
    schemas: dict[str, T.StructType] = {}

    def kept(session: SparkSession, name: str, df: DataFrame) -> DataFrame:
        if name not in schemas:
            df.write.parquet(f"{folder}/{name}")
            schemas[name] = df.schema
        return session.read.schema(schemas[name]).parquet(f"{folder}/{name}")

    return lambda session: bind(session, directory, kept)


def bind(spark: SparkSession, directory: str, kept: Kept | None = None) -> Tables:
    """The business tables over a warehouse directory; each is built when first used.

    Status and type columns are nested two-way choices over null-safe tests, because a
    filter on the chosen value then simplifies to a plain predicate for the scan.

    `kept` is given what takes joins of large tables, the customers and the installed
    equipment, by name; see `bind_once`.  All other tables are projections of the warehouse's
    files.
    """

    def stored(name: str, df: DataFrame) -> DataFrame:
        return kept(spark, name, df) if kept else df

    def raw(name: str) -> DataFrame:
        return read_warehouse(spark, directory, name)

    def quoted(codes: tuple[str, ...]) -> str:
        return ", ".join(f"'{code}'" for code in codes)

    def account_managers() -> DataFrame:
        # nation and region hold 25 and 5 rows at any scale; the strategy of their
        # joins is left to their file sizes.
        return (
            raw("supplier")
            .join(raw("nation"), F.expr("s_nationkey = n_nationkey"))
            .join(raw("region"), F.expr("n_regionkey = r_regionkey"))
            .selectExpr(
                "s_suppkey AS id",
                "s_name AS name",
                "concat(s_name, '@example.com') AS email",
                "r_name AS region",
            )
        )

    def customers() -> DataFrame:
        # Both right sides have one row per join key, so the optimizer drops a join
        # whose column (country, acquisition_date) is not read.
        nation = raw("nation").dropDuplicates(["n_nationkey"])
        first_order = raw("orders").groupBy("o_custkey").agg(
            F.min("o_orderdate").alias("first_ts")
        )
        return stored(
            "customers",
            raw("customer")
            .join(nation, F.expr("c_nationkey = n_nationkey"), "left")
            .join(first_order, F.expr("c_custkey = o_custkey"), "left")
            .selectExpr(
                "c_custkey AS id",
                "c_name AS name",
                "n_name AS country",
                f"IF(c_mktsegment IN ({quoted(ENTERPRISE_SEGMENTS)}), 'enterprise', "
                f"IF(c_mktsegment IN ({quoted(MID_MARKET_SEGMENTS)}), 'mid_market', 'smb')) "
                "AS segment",
                f"c_custkey % {MANAGERS} AS account_manager_id",
                "CAST(first_ts AS DATE) AS acquisition_date",
                "IF(c_acctbal < 0, 'churned', IF(c_acctbal < 500, 'inactive', 'active')) "
                "AS status",
            ),
        )

    def products() -> DataFrame:
        return raw("part").selectExpr(
            "p_partkey AS id",
            "p_name AS name",
            "p_brand AS category",
            "p_retailprice AS list_price",
            f"IF(p_type IN ({quoted(EQUIPMENT_TYPES)}), 'equipment', "
            f"IF(p_type IN ({quoted(SPARE_PART_TYPES)}), 'spare_part', 'service_package')) "
            "AS product_type",
        )

    def orders() -> DataFrame:
        return raw("orders").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS customer_id",
            f"o_custkey % {MANAGERS} AS account_manager_id",
            "CAST(o_orderdate AS DATE) AS order_date",
            "o_totalprice AS total_value",
            "IF(o_orderstatus <=> 'F', 'completed', "
            "IF(o_orderstatus <=> 'O', 'pending', 'cancelled')) AS status",
        )

    def order_lines() -> DataFrame:
        return raw("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber AS id",
            "l_orderkey AS order_id",
            "l_partkey AS product_id",
            "l_quantity AS quantity",
            "l_extendedprice / NULLIF(l_quantity, 0) AS unit_price",
            "l_extendedprice AS line_value",
        )

    @cache
    def installed() -> DataFrame:
        """One row per (order, line number) of urgent equipment lines.

        The list price travels with its part key through the same aggregate, so that
        contracts need no second join to part.  The greatest line status is kept as
        flags: all buffers are primitive, which keeps the aggregate hash-based with a
        map-side combine.
        """
        urgent = raw("orders").filter(F.col("o_orderpriority") == URGENT)
        equipment = raw("part").filter(F.col("p_type").isin(*EQUIPMENT_TYPES))
        return stored(
            "installed",
            raw("lineitem")
            .join(urgent, F.expr("l_orderkey = o_orderkey"))
            .join(equipment, F.expr("l_partkey = p_partkey"))
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.expr("min(o_custkey) AS customer_id"),
                F.expr("min(l_partkey) AS product_id"),
                F.expr("min_by(p_retailprice, l_partkey) AS list_price"),
                F.expr("CAST(min(l_shipdate) AS DATE) AS installation_date"),
                F.expr(
                    "max(l_linestatus <=> 'O') AND NOT coalesce(max(l_linestatus > 'O'), false) "
                    "AS is_open"
                ),
            )
            .withColumn("id", F.expr("l_orderkey * 10 + l_linenumber")),
        )

    def machines() -> DataFrame:
        return installed().selectExpr(
            "id",
            "customer_id",
            "product_id",
            "concat('SN-', id) AS serial_number",
            "installation_date",
            "IF(is_open, 'active', 'decommissioned') AS status",
        )

    def service_contracts() -> DataFrame:
        return (
            installed()
            .filter("id % 4 < 3")
            .selectExpr(
                "id",
                "customer_id",
                "id AS machine_id",
                "installation_date AS start_date",
                f"date_add(installation_date, {CONTRACT_DAYS}) AS end_date",
                f"list_price * CAST({CONTRACT_RATE} AS DOUBLE) AS annual_value",
                "IF(id % 4 = 0, 'active', IF(id % 4 = 1, 'expired', 'cancelled')) AS status",
            )
        )

    def quotes() -> DataFrame:
        return raw("events").selectExpr(
            "event_id AS id",
            "user_id AS customer_id",
            f"user_id % {MANAGERS} AS account_manager_id",
            f"date_add(DATE '{QUOTE_CREATED_FROM}', dayofmonth(ts) - 1) AS created_date",
            f"IF(event_type <> 'signup', date_add(DATE '{QUOTE_SENT_FROM}', "
            "dayofmonth(ts) - 1), NULL) AS sent_date",
            "CAST(NULL AS DATE) AS expiry_date",
            "value AS total_value",
            "IF(event_type <=> 'signup', 'draft', IF(event_type <=> 'click', 'sent', "
            "IF(event_type <=> 'purchase', 'won', IF(event_type <=> 'error', 'lost', "
            "'expired')))) AS status",
        )

    return Tables(
        {
            "account_managers": account_managers,
            "customers": customers,
            "products": products,
            "machines": machines,
            "service_contracts": service_contracts,
            "orders": orders,
            "order_lines": order_lines,
            "quotes": quotes,
        }
    )


# The same binding as common table expressions.  The first one keeps the raw orders
# reachable once the business table of that name is defined.
BINDING_SQL = f"""
raw_orders AS (SELECT * FROM orders),
account_managers AS (
  SELECT s_suppkey AS id, s_name AS name, s_name || '@example.com' AS email,
         r_name AS region
  FROM supplier
  JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey
),
customers AS (
  SELECT c_custkey AS id, c_name AS name, n_name AS country,
         CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'enterprise'
              WHEN c_mktsegment IN ('FURNITURE', 'AUTOMOBILE') THEN 'mid_market'
              ELSE 'smb' END AS segment,
         c_custkey % {MANAGERS} AS account_manager_id,
         CAST(first_ts AS DATE) AS acquisition_date,
         CASE WHEN c_acctbal < 0 THEN 'churned' WHEN c_acctbal < 500 THEN 'inactive'
              ELSE 'active' END AS status
  FROM customer
  JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_ts FROM raw_orders
             GROUP BY o_custkey) f ON o_custkey = c_custkey
),
products AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS category,
         p_retailprice AS list_price,
         CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'equipment'
              WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'spare_part'
              ELSE 'service_package' END AS product_type
  FROM part
),
order_lines AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id,
         l_partkey AS product_id, l_quantity AS quantity,
         l_extendedprice / NULLIF(l_quantity, 0) AS unit_price,
         l_extendedprice AS line_value
  FROM lineitem
),
machines AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, MIN(o_custkey) AS customer_id,
         MIN(l_partkey) AS product_id,
         'SN-' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS serial_number,
         CAST(MIN(l_shipdate) AS DATE) AS installation_date,
         CASE WHEN MAX(l_linestatus) = 'O' THEN 'active' ELSE 'decommissioned' END AS status
  FROM lineitem
  JOIN raw_orders ON o_orderkey = l_orderkey
  JOIN part ON p_partkey = l_partkey
  WHERE o_orderpriority = '{URGENT}' AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO')
  GROUP BY l_orderkey, l_linenumber
),
service_contracts AS (
  SELECT machines.id, customer_id, machines.id AS machine_id,
         installation_date AS start_date,
         CAST(installation_date + INTERVAL {CONTRACT_DAYS} DAY AS DATE) AS end_date,
         list_price * CAST({CONTRACT_RATE} AS DOUBLE) AS annual_value,
         CASE machines.id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'expired'
              ELSE 'cancelled' END AS status
  FROM machines JOIN products ON products.id = product_id
  WHERE machines.id % 4 < 3
),
quotes AS (
  SELECT event_id AS id, user_id AS customer_id, user_id % {MANAGERS} AS account_manager_id,
         CAST(DATE '{QUOTE_CREATED_FROM}' + (EXTRACT(day FROM ts) - 1) * INTERVAL 1 DAY
              AS DATE) AS created_date,
         CASE WHEN event_type <> 'signup' THEN
           CAST(DATE '{QUOTE_SENT_FROM}' + (EXTRACT(day FROM ts) - 1) * INTERVAL 1 DAY
                AS DATE) END AS sent_date,
         CAST(NULL AS DATE) AS expiry_date, value AS total_value,
         CASE event_type WHEN 'signup' THEN 'draft' WHEN 'click' THEN 'sent'
              WHEN 'purchase' THEN 'won' WHEN 'error' THEN 'lost' ELSE 'expired' END AS status
  FROM events
),
orders AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id,
         o_custkey % {MANAGERS} AS account_manager_id,
         CAST(o_orderdate AS DATE) AS order_date, o_totalprice AS total_value,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
              ELSE 'cancelled' END AS status
  FROM raw_orders
)"""


def with_binding(sql: str) -> str:
    """A query over the business tables as one statement over the warehouse."""
    return f"WITH {BINDING_SQL.strip()}\nSELECT * FROM (\n{sql.strip().rstrip(';')}\n) AS bound"
