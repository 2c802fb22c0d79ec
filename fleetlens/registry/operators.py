"""The operators as named queries over the warehouse, with their SQL counterparts.

Where an operator needs an input the warehouse does not hold (responses, completions,
scored results), Spark derives it from whole warehouse tables by the rules below, and
the SQL derives it the same way.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import text
from fleetlens.functions.numbers import half_even_2
from fleetlens.model import (
    ALLOWED_VALUES,
    DERIVED_TOTALS,
    FOREIGN_KEYS,
    SCHEMAS,
    UNIQUE_KEYS,
    Tables,
)
from fleetlens.operators import chat, compare, integrity, ranking, rewards
from fleetlens.plans import definitions, evaluation, scoreboard
from fleetlens.plans.catalogue import EVAL, TRAIN, CatalogueQuery, ansi_days, spark_days
from fleetlens.registry.reports import Query, warehouse_catalogue
from fleetlens.sources import results, runner
from fleetlens.sources.binding import AS_OF, bind, bind_once, read_warehouse, with_binding
from fleetlens.sources.checkpoints import checkpoint_dir
from fleetlens.sources.tables import create_empty_tables, read_tables, write_tables

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- Running query texts ------------------------------------------------------------


def _text_of(number: int, days) -> str:
    found = {e.query_id: e.sql for e in warehouse_catalogue(days) if e.split == EVAL}
    return found[number]


@_query("s07_run_query_text", with_binding(_text_of(20, ansi_days)))
def _run_query_text(spark: SparkSession, directory: str) -> DataFrame:
    texts = runner.QueryRunner(spark, lambda session: bind(session, directory))
    return texts.query(_text_of(20, spark_days))


# Questions whose text ranks or sums over one window of the whole table: their reports, which
# do not, are counted instead.
_RANKED = {EVAL: [6], TRAIN: [23, 27]}


@_query(
    "g07_catalogue_row_counts",
    with_binding(
        "\nUNION ALL\n".join(
            f"SELECT '{e.split}' AS split, CAST({e.query_id} AS INT) AS query_id, "
            f"COUNT(*) AS n_rows FROM (\n{e.sql}\n) AS {e.split}_{e.query_id}"
            for e in warehouse_catalogue()
        )
    ),
)
def _catalogue_row_counts(spark: SparkSession, directory: str) -> DataFrame:
    # What binding derives by joins is stored once; all texts read it.
    open_tables = bind_once(spark, directory)
    tables = open_tables(spark)
    counted = []
    for split, ranked in _RANKED.items():
        asked: dict[int, str | DataFrame] = {
            e.query_id: e.sql for e in warehouse_catalogue(spark_days) if e.split == split
        }
        truth = evaluation.report_truth(tables, AS_OF, split, only=ranked)
        counts = runner.row_counts(spark, open_tables, asked | truth, all_or_none=True)
        counted.append(counts.select(F.lit(split).alias("split"), "query_id", "n_rows"))
    return reduce(DataFrame.unionByName, counted)


# --- Definitions and ranks ----------------------------------------------------------


@_query(
    "d08_active_accounts",
    with_binding(
        """
SELECT id, name, country, segment, status FROM customers
WHERE id IN (SELECT customer_id FROM orders
             WHERE status = 'completed' AND order_date >= DATE '2000-08-01')"""
    ),
)
def _active_accounts(spark: SparkSession, directory: str) -> DataFrame:
    accounts = definitions.active_accounts(bind(spark, directory), AS_OF)
    return accounts.select("id", "name", "country", "segment", "status")


@_query(
    "w01_ntile_order_value",
    "SELECT o_orderkey, CAST(NTILE(5) OVER (ORDER BY o_totalprice, o_orderkey) AS INT) AS tile "
    "FROM orders",
)
def _ntile_order_value(spark: SparkSession, directory: str) -> DataFrame:
    orders = read_warehouse(spark, directory, "orders").select("o_orderkey", "o_totalprice")
    tiled = ranking.global_ntile(orders, "o_totalprice", "o_orderkey", 5, "tile")
    return tiled.select("o_orderkey", "tile")


@_query(
    "w03_latest_order_per_customer",
    """
SELECT o_custkey, o_orderkey FROM (
  SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders
) AS numbered WHERE place = 1""",
)
def _latest_order(spark: SparkSession, directory: str) -> DataFrame:
    orders = read_warehouse(spark, directory, "orders")
    latest = ranking.latest_per_key(
        orders.select("o_custkey", "o_orderkey", "o_orderdate"),
        "o_custkey",
        [F.desc("o_orderdate"), F.asc("o_orderkey")],
    )
    return latest.select("o_custkey", "o_orderkey")


@_query(
    "w04_rank_order_priority",
    "SELECT o_orderkey, CAST(RANK() OVER (ORDER BY o_orderpriority) AS BIGINT) AS place FROM orders",
)
def _rank_order_priority(spark: SparkSession, directory: str) -> DataFrame:
    """Five values over the whole table: every tie is longer than a range."""
    orders = read_warehouse(spark, directory, "orders").select("o_orderkey", "o_orderpriority")
    ranked = ranking.global_rank(
        orders, "o_orderpriority", "o_orderkey", "place", descending=False
    )
    return ranked.select("o_orderkey", "place")


@_query(
    "u02_bag_equality",
    """
WITH o AS (SELECT o_custkey, o_orderpriority FROM orders), cases AS (
  SELECT 'other order' AS copy, * FROM o
  UNION ALL SELECT 'rows missing', * FROM o WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT 'no repeats', * FROM (SELECT DISTINCT * FROM o)
), names AS (
  SELECT DISTINCT copy FROM cases
)
SELECT copy, NOT EXISTS (
         SELECT * FROM o EXCEPT ALL
         SELECT o_custkey, o_orderpriority FROM cases AS c WHERE c.copy = names.copy
       ) AND NOT EXISTS (
         SELECT o_custkey, o_orderpriority FROM cases AS c WHERE c.copy = names.copy
         EXCEPT ALL SELECT * FROM o
       ) AS equal
FROM names""",
)
def _bag_equality(spark: SparkSession, directory: str) -> DataFrame:
    """A copy in another order, one with rows missing, one without repeats."""
    orders = read_warehouse(spark, directory, "orders").select("o_custkey", "o_orderpriority")
    copies = {
        "other order": orders.repartition(F.col("o_orderpriority")),
        "rows missing": orders.filter("o_orderpriority <> '5-LOW'"),
        "no repeats": orders.distinct(),
    }
    found = [
        compare.bags_equal(orders, copy).select(F.lit(name).alias("copy"), "equal")
        for name, copy in copies.items()
    ]
    return reduce(DataFrame.unionByName, found)


# --- Column functions ---------------------------------------------------------------

_NET = "l_extendedprice * (1 - l_discount)"


@_query(
    "f14_half_even_rounding",
    f"""
WITH net AS (SELECT l_orderkey, l_linenumber, {_NET} AS v FROM lineitem),
halves AS (
  SELECT *, FLOOR(v * 1e2) AS low, v * 134217729e0 - (v * 134217729e0 - v) AS high_part FROM net
),
placed AS (
  SELECT *, (high_part * 2e2 - (low * 2e0 + 1e0)) + (v - high_part) * 2e2 AS above FROM halves
)
SELECT l_orderkey, l_linenumber,
       (low + CASE WHEN above > 0 OR (above = 0 AND low % 2e0 <> 0) THEN 1 ELSE 0 END) / 1e2
         AS rounded
FROM placed""",
)
def _half_even(spark: SparkSession, directory: str) -> DataFrame:
    lines = read_warehouse(spark, directory, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", half_even_2(F.expr(_NET)).alias("rounded"))


# Column names built from customer names under each of the known prefixes and none.
_LABEL = (
    "CASE c_nationkey % 5 WHEN 0 THEN 'Customer_' || c_name WHEN 1 THEN 'TOTAL_' || c_name "
    "WHEN 2 THEN ' account_manager_' || c_name WHEN 3 THEN 'product_id' ELSE c_name END"
)


@_query(
    "f15_canonical_names",
    f"""
WITH labels_in AS (SELECT c_custkey, LOWER(TRIM({_LABEL})) AS label FROM customer)
SELECT c_custkey,
       CASE WHEN label LIKE 'customer@_%' ESCAPE '@' AND LENGTH(label) > 11 THEN SUBSTR(label, 10)
            WHEN label LIKE 'account@_manager@_%' ESCAPE '@' AND LENGTH(label) > 18
              THEN SUBSTR(label, 17)
            WHEN label LIKE 'total@_%' ESCAPE '@' AND LENGTH(label) > 8 THEN SUBSTR(label, 7)
            WHEN label LIKE 'product@_%' ESCAPE '@' AND LENGTH(label) > 10 THEN SUBSTR(label, 9)
            ELSE label END AS canonical
FROM labels_in""",
)
def _canonical_names(spark: SparkSession, directory: str) -> DataFrame:
    customers = read_warehouse(spark, directory, "customer")
    return customers.select("c_custkey", text.canonical_name(F.expr(_LABEL)).alias("canonical"))


# --- Response cleaning and rewards --------------------------------------------------

# Raw responses: every turn's whole text in one of four wrappings.
_RESPONSE = (
    "CASE WHEN role = 'system' THEN NULL "
    "WHEN role = 'user' THEN ' ' || text || '; ' "
    "WHEN turn % 4 = 1 "
    "THEN '<think>' || text || '</think> ```sql\n SELECT ' || text || ' ;\n``` ;' "
    "ELSE 'So: ```' || text || '; SELECT 1``` <think>;</think>' END"
)
_RESPONSES_SQL = f"responses AS (SELECT conv_id, turn, {_RESPONSE} AS raw FROM conversations)"


def _trim_sql(value: str) -> str:
    return f"TRIM({value}, {_quote(text.EDGE_SPACE)})"


_CLEANED_SQL = f"""{_RESPONSES_SQL},
thoughtless AS (
  SELECT *, {_trim_sql(f"REGEXP_REPLACE(COALESCE(raw, ''), {_quote(text.THINK_BLOCK)}, '', 'g')")}
    AS spoken FROM responses
),
unfenced AS (
  SELECT *, {_trim_sql(
      f"CASE WHEN REGEXP_MATCHES(spoken, {_quote(text.FENCED_BLOCK)}) "
      f"THEN REGEXP_EXTRACT(spoken, {_quote(text.FENCED_BLOCK)}, 1) ELSE spoken END"
  )} AS body FROM thoughtless
),
cleaned AS (
  SELECT conv_id, turn, raw, spoken,
         CASE WHEN STRPOS(body, ';') > 0 THEN SUBSTR(body, 1, STRPOS(body, ';')) ELSE body END
           AS sql
  FROM unfenced
)"""


def _responses(spark: SparkSession, directory: str) -> DataFrame:
    turns = read_warehouse(spark, directory, "conversations")
    return turns.select("conv_id", "turn", F.expr(_RESPONSE).alias("raw"))


@_query(
    "x05_extract_sql", f"WITH {_CLEANED_SQL} SELECT conv_id, turn, spoken, sql FROM cleaned"
)
def _extract(spark: SparkSession, directory: str) -> DataFrame:
    raw = F.col("raw")
    return _responses(spark, directory).select(
        "conv_id",
        "turn",
        text.drop_think_blocks(F.coalesce(raw, F.lit(""))).alias("spoken"),
        text.extract_sql(raw).alias("sql"),
    )


_EXCHANGES_SQL = """exchanges AS (
  SELECT a.conv_id, r.turn, a.text AS question, r.text AS answer
  FROM conversations AS a JOIN conversations AS r
    ON r.conv_id = a.conv_id AND r.turn = a.turn + 1
  WHERE a.role = 'user' AND r.role = 'assistant'
)"""
_PROMPT = chat.system_prompt(AS_OF)


def _exchanges(spark: SparkSession, directory: str) -> DataFrame:
    return chat.exchanges(read_warehouse(spark, directory, "conversations"))


@_query(
    "b02_prompt_rows",
    f"""
WITH {_EXCHANGES_SQL}
SELECT conv_id, turn, 'system: ' || {_quote(_PROMPT)} || chr(10) || 'user: ' || question AS prompt,
       {_trim_sql("answer")} AS ground_truth_sql
FROM exchanges""",
)
def _prompt_rows(spark: SparkSession, directory: str) -> DataFrame:
    rows = chat.prompt_rows(_exchanges(spark, directory), _PROMPT)
    return rows.select(
        "conv_id", "turn", chat.transcript("prompt").alias("prompt"), "ground_truth_sql"
    )


@_query(
    "b03_supervised_rows",
    f"""
WITH {_EXCHANGES_SQL}
SELECT conv_id, turn,
       'system: ' || {_quote(_PROMPT)} || chr(10) || 'user: ' || question || chr(10)
       || 'assistant: ' || {_trim_sql("answer")} AS messages
FROM exchanges""",
)
def _supervised_rows(spark: SparkSession, directory: str) -> DataFrame:
    rows = chat.supervised_rows(_exchanges(spark, directory), _PROMPT)
    return rows.select("conv_id", "turn", chat.transcript("messages").alias("messages"))


@_query(
    "b04_question_overlap",
    f"""
SELECT doc_id FROM documents
WHERE lang = 'en' AND {_trim_sql("LOWER(text)")} IN (
  SELECT {_trim_sql("LOWER(text)")} FROM documents WHERE lang <> 'en'
  UNION ALL SELECT {_trim_sql("LOWER(text)")} FROM benchmark
  UNION ALL SELECT {_trim_sql("LOWER(text)")} FROM documents WHERE source = 'src1')""",
)
def _question_overlap(spark: SparkSession, directory: str) -> DataFrame:
    """English documents against everything held out: other languages, one source and
    the benchmark items."""
    documents = read_warehouse(spark, directory, "documents").select(
        "doc_id", "lang", "source", "text"
    )
    held_out = documents.filter("lang <> 'en' OR source = 'src1'").select("text")
    held_out = held_out.unionByName(read_warehouse(spark, directory, "benchmark").select("text"))
    train = documents.filter("lang = 'en'").select("doc_id", "text")
    return chat.overlapping_questions(train, held_out, "text").select("doc_id")


# --- Scoreboard ---------------------------------------------------------------------

# Scored results: a document is one answer, its source the model, its length in thousands
# of characters the question.  Without a label the truth failed and there is no verdict.
_RESULT_COLUMNS = """d.source AS model_name,
  CAST(FLOOR(d.n_chars / 1e3) AS INT) + 1 AS query_id, d.text AS question,
  CASE WHEN d.n_chars < 1000 THEN 'easy' WHEN d.n_chars < 3000 THEN 'medium' ELSE 'hard' END
    AS difficulty,
  l.doc_id IS NULL OR l.quality = 1 OR l.toxic = 0 AS execution_success,
  CASE WHEN l.doc_id IS NULL THEN CAST(NULL AS DOUBLE)
       WHEN l.quality = 1 AND l.toxic = 0 THEN CAST(1 AS DOUBLE)
       WHEN l.quality = 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS result_match,
  d.doc_id AS ground_truth_row_count, d.n_chars AS generated_row_count"""
_RESULTS_SQL = f"""results AS (
  SELECT {_RESULT_COLUMNS} FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id
)"""


def _results(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_warehouse(spark, directory, "documents").alias("d")
    labels = read_warehouse(spark, directory, "labels").alias("l")
    return documents.join(labels, F.expr("l.doc_id = d.doc_id"), "left").selectExpr(
        *_split_columns(_RESULT_COLUMNS)
    )


def _split_columns(columns: str) -> list[str]:
    """The column list as separate expressions; no expression holds a comma itself."""
    return [c.strip() for c in columns.split(",")]


@_query(
    "k01_run_status",
    f"""
WITH {_RESULTS_SQL}
SELECT model_name, ground_truth_row_count AS answer_id,
       CASE WHEN result_match IS NULL THEN 'UNSCORED'
            WHEN result_match = 1 THEN 'MATCH' WHEN result_match = 0.5 THEN 'PARTIAL'
            ELSE CASE WHEN execution_success THEN 'FAIL' ELSE 'ERROR' END END AS status
FROM results""",
)
def _run_status(spark: SparkSession, directory: str) -> DataFrame:
    return _results(spark, directory).select(
        "model_name",
        F.col("ground_truth_row_count").alias("answer_id"),
        scoreboard.run_status().alias("status"),
    )


@_query(
    "k03_model_summary",
    f"""
WITH {_RESULTS_SQL}
SELECT model_name, COUNT(*) AS total_queries,
       ROUND(AVG(CAST(execution_success AS INT)), 4) AS execution_accuracy,
       ROUND(AVG(result_match), 4) AS result_match_avg,
       COUNT(*) FILTER (WHERE result_match = 1) AS queries_passed
FROM results GROUP BY model_name""",
)
def _model_summary(spark: SparkSession, directory: str) -> DataFrame:
    return scoreboard.model_summary(_results(spark, directory))


@_query(
    "k05_match_table",
    f"""
WITH {_RESULTS_SQL}
SELECT 'Q' || query_id AS query, model_name AS model, result_match, difficulty FROM results""",
)
def _match_table(spark: SparkSession, directory: str) -> DataFrame:
    return scoreboard.match_table(_results(spark, directory))


@_query(
    "k06_score_by_difficulty",
    f"""
WITH {_RESULTS_SQL}
SELECT difficulty, model_name AS model, ROUND(AVG(result_match), 6) AS mean_match
FROM results GROUP BY difficulty, model_name""",
)
def _score_by_difficulty(spark: SparkSession, directory: str) -> DataFrame:
    scores = scoreboard.score_by_difficulty(_results(spark, directory))
    return scores.withColumn("mean_match", F.round("mean_match", 6))


@_query(
    "k07_model_comparison",
    f"""
WITH {_RESULTS_SQL}
SELECT query_id, model_name AS model, ROUND(AVG(result_match), 6) AS mean_match
FROM results GROUP BY query_id, model_name""",
)
def _model_comparison(spark: SparkSession, directory: str) -> DataFrame:
    compared = scoreboard.model_comparison(_results(spark, directory))
    return compared.withColumn("mean_match", F.round("mean_match", 6))


@_query(
    "k08_detail_table",
    f"""
WITH {_RESULTS_SQL}
SELECT model_name, query_id, difficulty,
       CASE WHEN result_match IS NULL THEN 'Unscored' WHEN result_match = 1 THEN 'Pass'
            WHEN result_match = 0.5 THEN 'Partial' ELSE 'Fail' END AS status,
       question, SUBSTR(question, 1, 80) AS question_label, ground_truth_row_count, generated_row_count,
       result_match
FROM results""",
)
def _detail_table(spark: SparkSession, directory: str) -> DataFrame:
    return scoreboard.detail_table(_results(spark, directory))


@_query(
    "s03_stored_tables",
    with_binding(
        "\nUNION ALL\n".join(
            f"SELECT '{name}' AS table_name, COUNT(*) AS n_rows, CAST(COALESCE(SUM("
            f"{'id' if 'id' in SCHEMAS[name].names else SCHEMAS[name].names[0]}), 0) AS BIGINT) AS keys "
            f"FROM {name}"
            for name in SCHEMAS
            if name != "quote_lines"
        )
        + "\nUNION ALL\nSELECT 'quote_lines' AS table_name, 0 AS n_rows, 0 AS keys"
    ),
)
def _stored_tables(spark: SparkSession, directory: str) -> DataFrame:
    """Empty tables are created, the bound ones written in their place, all read back."""
    folder = f"{checkpoint_dir(spark)}/business-{uuid.uuid4().hex}"
    create_empty_tables(spark, folder)
    write_tables(bind(spark, directory), folder, mode="overwrite")
    counted = []
    for name, df in read_tables(spark, folder).items():
        key = "id" if "id" in df.columns else df.columns[0]
        counted.append(
            df.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.coalesce(F.sum(key), F.lit(0)).cast("bigint").alias("keys"),
            ).select(F.lit(name).alias("table_name"), "n_rows", "keys")
        )
    return reduce(DataFrame.unionByName, counted)


@_query(
    "f21_padded_labels",
    "SELECT c_custkey AS id, 'customer-' || CASE WHEN c_custkey < 100000 "
    "THEN LPAD(CAST(c_custkey AS VARCHAR), 5, '0') ELSE CAST(c_custkey AS VARCHAR) END AS label "
    "FROM customer",
)
def _padded_labels(spark: SparkSession, directory: str) -> DataFrame:
    return read_warehouse(spark, directory, "customer").select(
        F.col("c_custkey").alias("id"),
        text.padded_label("customer-", 5, F.col("c_custkey")).alias("label"),
    )


@_query(
    "s06_score_files",
    f"""
WITH {_RESULTS_SQL}
SELECT model_name, query_id, difficulty, execution_success, result_match,
       ground_truth_row_count, question
FROM results""",
)
def _score_files(spark: SparkSession, directory: str) -> DataFrame:
    """Writes the results of each model below a folder of its own and reads all back."""
    flat = _results(spark, directory).select(
        "model_name",
        "query_id",
        "question",
        "difficulty",
        F.lit(None).cast("string").alias("ground_truth_sql"),
        F.lit(None).cast("string").alias("generated_sql"),
        "execution_success",
        F.lit(None).cast("string").alias("execution_error"),
        "ground_truth_row_count",
        "generated_row_count",
        "result_match",
    )
    folder = f"{checkpoint_dir(spark)}/scores-{uuid.uuid4().hex}"
    results.write_score_files(flat, folder)
    return results.read_score_files(spark, folder).select(
        "model_name",
        "query_id",
        "difficulty",
        "execution_success",
        "result_match",
        "ground_truth_row_count",
        "question",
    )


# --- Comparison ---------------------------------------------------------------------

# Truth results and perturbed copies of them, over whole tables.  Each truth row has a
# text of its own, so the SQL below can state which rows match under the tolerance.
# Columns: query, scale of the copy's value, condition on rows the copy keeps.
_PERTURBED = (
    (1, "1e0", "TRUE"),
    (2, "1.01e0", "TRUE"),
    (3, "1.01e0", "o_orderpriority <> '1-URGENT'"),
    (4, "1.01e0", "o_orderstatus = 'F'"),
    (5, "1.05e0", "TRUE"),
    (6, "1e0", "FALSE"),
)
_TRUTH_ROW = ["concat('order ', o_orderkey) AS label", "o_totalprice AS total_value"]


def _pairs(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    orders = read_warehouse(spark, directory, "orders")
    pairs = []
    for number, scale, kept in _PERTURBED:
        truth = orders.selectExpr(*_TRUTH_ROW)
        # The copy swaps and renames its columns and has one more.
        copy = orders.filter(kept).selectExpr(
            f"o_totalprice * {scale} AS VALUE", "o_custkey AS buyer", _TRUTH_ROW[0]
        )
        pairs.append((number, truth, copy))
    # Not written: the comparer reads the rows twice, which costs less than writing their cells.
    return _stored_pairs(spark, pairs)


def _scores_sql(close: str) -> str:
    parts = []
    for number, scale, kept in _PERTURBED:
        parts.append(
            f"SELECT {number} AS query_id, o_totalprice AS v, {kept} AS kept, "
            f"o_totalprice * {scale} AS w FROM orders"
        )
    return f"""
WITH perturbed AS ({" UNION ALL ".join(parts)}),
counted AS (
  SELECT CAST(query_id AS INT) AS query_id, COUNT(*) AS gt_rows,
         COUNT(*) FILTER (WHERE kept) AS gen_rows,
         COUNT(*) FILTER (WHERE kept AND {close}) AS matched
  FROM perturbed GROUP BY query_id
)
SELECT query_id, gt_rows, gen_rows, CAST(2 AS INT) AS mapped_columns, matched,
       CASE WHEN matched = gt_rows THEN CAST(1 AS DOUBLE)
            WHEN matched * 2 > gt_rows THEN CAST(0.5 AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS result_match
FROM counted"""


_SCORE_COLUMNS = ["query_id", "gt_rows", "gen_rows", "mapped_columns", "matched", "result_match"]


@_query(
    "r14_score_pairs",
    _scores_sql("ABS(v - w) <= GREATEST(ABS(v), ABS(w), 1) * 0.02"),
)
def _score_pairs(spark: SparkSession, directory: str) -> DataFrame:
    outcomes, rows = _pairs(spark, directory)
    return compare.score_pairs(outcomes, rows).select(*_SCORE_COLUMNS)


def _training_sql() -> str:
    """Exact names only, so the renamed value column does not count."""
    parts = [
        f"SELECT {number} AS query_id, {kept} AS kept FROM orders"
        for number, _, kept in _PERTURBED
    ]
    return f"""
WITH perturbed AS ({" UNION ALL ".join(parts)}),
counted AS (
  SELECT CAST(query_id AS INT) AS query_id, COUNT(*) AS gt_rows,
         COUNT(*) FILTER (WHERE kept) AS gen_rows, COUNT(*) FILTER (WHERE kept) AS matched
  FROM perturbed GROUP BY query_id
)
SELECT query_id, gt_rows, gen_rows, CAST(1 AS INT) AS mapped_columns, matched,
       CASE WHEN matched = gt_rows THEN CAST(1 AS DOUBLE)
            WHEN matched * 2 > gt_rows THEN CAST(0.5 AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS result_match
FROM counted"""


@_query("r15_training_scores", _training_sql())
def _training_scores(spark: SparkSession, directory: str) -> DataFrame:
    outcomes, rows = _pairs(spark, directory)
    return compare.score_pairs(outcomes, rows, training=True).select(*_SCORE_COLUMNS)


def _stored_pairs(
    spark: SparkSession, pairs: list[tuple[int, DataFrame, DataFrame]]
) -> tuple[DataFrame, DataFrame]:
    """Outcomes and rows of (number, truth, copy) results."""
    outcomes, rows = [], None
    for number, truth, copy in pairs:
        for side, df in ((results.TRUTH, truth), (results.GENERATED, copy)):
            outcomes.append(results.outcome_row("copy", number, side, df.columns))
            part = results.result_rows(df, "copy", number, side)
            rows = part if rows is None else rows.unionByName(part)
    return results.outcome_table(spark, outcomes), rows


# One segment is missing from the copy, so its balances compete for others' partners.
_FIT_SCALE, _FIT_KEPT = "1.015e0", "c_mktsegment <> 'BUILDING'"


@_query(
    "r11_first_fit_numbers",
    f"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER (ORDER BY c_custkey) AS i, round_even(c_acctbal, 2) AS v FROM customer
), g AS (
  SELECT row_number() OVER (ORDER BY c_custkey) AS j, round_even(c_acctbal * {_FIT_SCALE}, 2) AS w
  FROM customer WHERE {_FIT_KEPT}
), near AS (
  SELECT i, list(j ORDER BY j) AS js
  FROM t JOIN g ON ABS(v - w) <= GREATEST(ABS(v), ABS(w), 1) * 0.02 GROUP BY i
), walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT walk.i + 1,
         CASE WHEN len(list_filter(coalesce(js, []), lambda j: NOT list_contains(taken, j))) = 0
              THEN taken
              ELSE list_append(taken,
                list_filter(js, lambda j: NOT list_contains(taken, j))[1]) END
  FROM walk LEFT JOIN near ON near.i = walk.i + 1
  WHERE walk.i < (SELECT COUNT(*) FROM t)
), counted AS (
  SELECT (SELECT COUNT(*) FROM t) AS gt_rows, (SELECT COUNT(*) FROM g) AS gen_rows,
         CAST(MAX(len(taken)) AS BIGINT) AS matched
  FROM walk
)
SELECT CAST(1 AS INT) AS query_id, gt_rows, gen_rows, CAST(1 AS INT) AS mapped_columns, matched,
       CASE WHEN matched = gt_rows THEN CAST(1 AS DOUBLE)
            WHEN matched * 2 > gt_rows THEN CAST(0.5 AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS result_match
FROM counted""",
)
def _first_fit_numbers(spark: SparkSession, directory: str) -> DataFrame:
    """Numbers only, where one truth row is close to many generated ones and some find no
    partner.  First fit depends on the order of rows, which is that of the key."""
    customers = read_warehouse(spark, directory, "customer").orderBy("c_custkey")
    truth = customers.selectExpr("c_acctbal AS balance")
    copy = customers.filter(_FIT_KEPT).selectExpr(f"c_acctbal * {_FIT_SCALE} AS balance")
    outcomes, rows = _stored_pairs(spark, [(1, truth, copy)])
    return compare.score_pairs(outcomes, rows).select(*_SCORE_COLUMNS)


# Edges of the comparer: number, truth, copy, and the columns, matches and verdict expected
# of all rows (n) and of the rows outside one segment (m).
_EMPTY = "SELECT c_custkey AS id FROM customer WHERE FALSE"
_EDGES = (
    (1, _EMPTY, _EMPTY, "1", "0", "1"),
    (2, _EMPTY, "SELECT c_custkey AS id FROM customer", "1", "0", "0"),
    (
        3,
        "SELECT c_name AS name, c_acctbal AS balance FROM customer",
        "SELECT c_name AS a, c_acctbal AS b FROM customer",
        "0",
        "n",
        "1",
    ),
    (
        4,
        "SELECT c_name AS name, c_acctbal AS balance FROM customer",
        "SELECT c_name AS a, c_acctbal * 1.001e0 AS b FROM customer",
        "0",
        "0",
        "0",
    ),
    (
        5,
        "SELECT c_name AS name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance "
        "FROM customer",
        "SELECT CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_acctbal * 1.01e0 END "
        "AS balance, c_name AS name FROM customer",
        "2",
        "m",
        "CASE WHEN m = n THEN 1 WHEN m * 2 > n THEN 0.5 ELSE 0 END",
    ),
)


@_query(
    "r06_edge_pairs",
    "WITH k AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE c_mktsegment <> 'MACHINERY') AS m "
    "FROM customer)\n"
    + "\nUNION ALL\n".join(
        f"SELECT CAST({number} AS INT) AS query_id, (SELECT COUNT(*) FROM ({truth})) AS gt_rows, "
        f"(SELECT COUNT(*) FROM ({copy})) AS gen_rows, CAST({mapped} AS INT) AS mapped_columns, "
        f"CAST({matched} AS BIGINT) AS matched, CAST({expected} AS DOUBLE) AS result_match FROM k"
        for number, truth, copy, mapped, matched, expected in _EDGES
    ),
)
def _edge_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Empty results, equal rows under other names, no common name, nulls under tolerance."""
    customers = read_warehouse(spark, directory, "customer")
    pairs = [
        (number, *(spark.sql(text.replace("FROM customer", "FROM {customer}"), customer=customers)
                   for text in (truth, copy)))
        for number, truth, copy, *_ in _EDGES
    ]
    return compare.score_pairs(*_stored_pairs(spark, pairs)).select(*_SCORE_COLUMNS)


# --- From raw responses to scores and rewards ----------------------------------------

# Every customer is a model that answers one question, or a sample of one prompt.  Which, and
# what it answers, follow from its key: right, partly, wrongly, unparsable text, text that
# fails while it runs, nothing.  All of these questions name customers and compare exactly.
_ASKED = ((EVAL, (7, 9, 18, 20)), (TRAIN, (1, 13, 16, 22, 25, 26)))
_TRAINING_FROM = 100  # numbers of training questions, which else are those of others
_PART = "name NOT LIKE '%7'"
_ANSWERS = (
    "Sure:\n```sql\n{truth};\n```",
    "SELECT * FROM (\n{truth}\n) AS part WHERE " + _PART,
    "SELECT 'nobody' AS name",
    "SELEC name FROM customers",
    "SELECT name FROM customers WHERE id = (SELECT id FROM customers)",
    "",
)


def _asked(days) -> list[CatalogueQuery]:
    """The questions asked, numbered apart."""
    numbers = dict(_ASKED)
    return [
        replace(e, query_id=e.query_id + (0 if e.split == EVAL else _TRAINING_FROM))
        for e in warehouse_catalogue(days)
        if e.query_id in numbers[e.split]
    ]


_QUESTIONS = sorted(e.query_id for e in _asked(ansi_days))
_QUESTION = f"c_custkey % {len(_QUESTIONS)}"
_ANSWER = f"CAST(FLOOR(c_custkey / {len(_QUESTIONS)}e0) AS BIGINT) % {len(_ANSWERS)}"
_ANSWERED_SQL = f"""answered AS (
  SELECT c_custkey AS customer, query_id, answer, opens, n, m
  FROM (SELECT c_custkey, {_QUESTION} AS place, {_ANSWER} AS answer FROM customer) AS a
  JOIN (
    {" UNION ALL ".join(
        f"SELECT {_QUESTIONS.index(e.query_id)} AS place, CAST({e.query_id} AS INT) AS query_id, "
        f"{e.sql.strip().upper().startswith('SELECT')} AS opens, COUNT(*) AS n, COUNT(*) FILTER (WHERE {_PART}) AS m FROM ({e.sql}) AS t{e.query_id}"
        for e in _asked(ansi_days)
    )}
  ) AS t ON t.place = a.place
)"""
_ANSWER_VERDICT = """CAST(CASE WHEN answer = 0 THEN 1
       WHEN answer = 1 AND m = n THEN 1 WHEN answer = 1 AND m * 2 > n THEN 0.5 ELSE 0 END AS DOUBLE)"""


def _answers(spark: SparkSession, directory: str) -> DataFrame:
    """customer, query_id and the raw text of the answer (null: none)."""
    truth = {e.query_id: e.sql for e in _asked(spark_days)}
    texts = [F.lit(a.format(truth=truth[q])) for q in _QUESTIONS for a in _ANSWERS]
    place = F.expr(f"CAST({_QUESTION} * {len(_ANSWERS)} + {_ANSWER} + 1 AS INT)")
    numbers = F.array(*map(F.lit, _QUESTIONS))
    return read_warehouse(spark, directory, "customer").select(
        F.col("c_custkey").alias("customer"),
        F.element_at(numbers, F.expr(f"CAST({_QUESTION} + 1 AS INT)")).alias("query_id"),
        F.nullif(F.element_at(F.array(*texts), place), F.lit("")).alias("raw"),
    )


@_query(
    "r13_score_responses",
    with_binding(f"""
WITH {_ANSWERED_SQL}
SELECT 'model' || customer AS model, query_id, answer < 3 AS execution_success,
       n AS ground_truth_row_count,
       CASE answer WHEN 0 THEN n WHEN 1 THEN m WHEN 2 THEN 1 ELSE 0 END AS generated_row_count,
       {_ANSWER_VERDICT} AS result_match
FROM answered"""),
)
def _score_responses(spark: SparkSession, directory: str) -> DataFrame:
    """Ten questions of both splits, one response per customer."""
    responses = _answers(spark, directory).select(
        F.concat(F.lit("model"), "customer").alias("model"), "query_id", "raw"
    )
    scored = evaluation.evaluate_responses(
        spark, bind_once(spark, directory), _asked(spark_days), responses
    )
    return scored.select(
        F.col("model_name").alias("model"),
        "query_id",
        "execution_success",
        "ground_truth_row_count",
        "generated_row_count",
        "result_match",
    )


_REWARDS_SQL = f"""{_ANSWERED_SQL}, rewarded AS (
  SELECT query_id AS prompt_id, customer AS sample_no,
         CAST(CASE WHEN answer IN (1, 2, 4) OR answer = 0 AND opens THEN 0.25 ELSE 0 END AS DOUBLE)
           AS format_reward,
         CAST(CASE WHEN answer < 3 THEN 0.5 ELSE 0 END AS DOUBLE) AS execution_reward,
         {_ANSWER_VERDICT} AS correctness_reward
  FROM answered
)"""


def _rewarded(spark: SparkSession, directory: str) -> DataFrame:
    """Rewards of completions of ten prompts, whose texts are run and compared."""
    completions = _answers(spark, directory).select(
        F.col("query_id").alias("prompt_id"),
        F.col("customer").alias("sample_no"),
        F.coalesce("raw", F.lit("")).alias("text"),
    )
    return evaluation.reward_completions(
        spark, bind_once(spark, directory), _asked(spark_days), completions
    )


@_query(
    "b05_completion_rewards",
    with_binding(f"""
WITH {_REWARDS_SQL}
SELECT prompt_id, sample_no, format_reward + execution_reward + correctness_reward AS reward
FROM rewarded"""),
)
def _completion_rewards(spark: SparkSession, directory: str) -> DataFrame:
    return _rewarded(spark, directory).select("prompt_id", "sample_no", "reward")


@_query(
    "b06_completion_runs",
    with_binding(f"""
WITH {_REWARDS_SQL}
SELECT prompt_id, sample_no, format_reward, execution_reward, correctness_reward FROM rewarded"""),
)
def _completion_runs(spark: SparkSession, directory: str) -> DataFrame:
    """The parts of each completion's reward."""
    return _rewarded(spark, directory).select(
        "prompt_id", "sample_no", "format_reward", "execution_reward", "correctness_reward"
    )


@_query(
    "b08_group_rewards",
    with_binding(f"""
WITH {_REWARDS_SQL}, totals AS (
  SELECT prompt_id, format_reward + execution_reward + correctness_reward AS reward FROM rewarded
)
SELECT prompt_id, COUNT(*) AS samples, ROUND(AVG(reward), 6) AS mean_reward,
       ROUND(STDDEV_SAMP(reward), 6) AS std_reward, MIN(reward) AS min_reward,
       MAX(reward) AS max_reward
FROM totals GROUP BY prompt_id"""),
)
def _group_rewards(spark: SparkSession, directory: str) -> DataFrame:
    """Statistics over the samples of each prompt, from verdicts of real runs."""
    groups = rewards.group_statistics(_rewarded(spark, directory))
    return groups.withColumns({c: F.round(c, 6) for c in ("mean_reward", "std_reward")})


# --- Constraints --------------------------------------------------------------------


def _bound_names() -> list[str]:
    return [name for name in SCHEMAS if name != "quote_lines"]


def _violation_sql(table: str, check: str, column: str, count: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{check}' AS check_name, '{column}' AS column_name, "
        f"CAST(({count}) AS BIGINT) AS bad"
    )


# The bound tables with known faults in a part of their rows, so that each check finds some.
_FAULTS = {
    "customers": {
        "name": "CASE WHEN id % 10 = 3 THEN NULL ELSE name END",
        "status": "CASE WHEN id % 9 = 4 THEN 'asleep' ELSE status END",
    },
    "machines": {
        "status": "CASE WHEN id % 8 = 5 THEN 'melted' ELSE status END",
        "customer_id": "CASE WHEN id % 6 = 1 THEN customer_id + 1000000000 ELSE customer_id END",
    },
    "orders": {
        "id": "CASE WHEN id % 5 = 2 THEN id - 1 ELSE id END",
        "order_date": "CASE WHEN id % 13 = 0 THEN NULL ELSE order_date END",
        "status": "CASE WHEN id % 7 = 0 THEN 'lost' ELSE status END",
        "customer_id": "CASE WHEN id % 11 = 0 THEN customer_id + 1000000000 ELSE customer_id END",
        # The bound totals hold tax and discount; most are set to what the lines add up to.
        "total_value": "CASE WHEN id % 3 = 0 THEN total_value ELSE COALESCE(line_sum, 0) END",
    },
}
_LINE_SUMS = "SELECT order_id AS line_order, SUM(line_value) AS line_sum FROM order_lines GROUP BY 1"


def _faulty_columns(table: str) -> list[str]:
    return [f"{_FAULTS[table].get(c, c)} AS {c}" for c in SCHEMAS[table].names]


def _faulty(tables: Tables) -> Tables:
    given = {name: getattr(tables, name) for name in _bound_names()}
    sums = given["order_lines"].groupBy(F.col("order_id").alias("line_order")).agg(
        F.sum("line_value").alias("line_sum")
    )
    given["orders"] = given["orders"].join(sums, F.expr("line_order = id"), "left")
    for name in _FAULTS:
        given[name] = given[name].selectExpr(*_faulty_columns(name))
    return Tables(given)


def _faulty_sql(parts: list[str]) -> str:
    """The parts over the faulty tables, which are called faulty_<name>."""
    made = []
    for name in _bound_names():
        columns = ", ".join(_faulty_columns(name)) if name in _FAULTS else "*"
        joined = f" LEFT JOIN ({_LINE_SUMS}) AS s ON s.line_order = orders.id"
        made.append(
            f"faulty_{name} AS (SELECT {columns} FROM {name}{joined if name == 'orders' else ''})"
        )
    union = "\nUNION ALL\n".join(parts)
    return with_binding(f"WITH {', '.join(made)}\n{union}")


def _of_kind(name: str, sql: list[str]) -> None:
    check = name.split("_", 1)[1]

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return integrity.all_violations(_faulty(bind(spark, directory)), kinds=(check,))

    _query(name, _faulty_sql(sql))(run)


_of_kind(
    "c01_not_null",
    [
        _violation_sql(
            t, "not_null", f.name, f"SELECT COUNT(*) FILTER (WHERE {f.name} IS NULL) FROM faulty_{t}"
        )
        for t in _bound_names()
        for f in SCHEMAS[t].fields
        if not f.nullable
    ],
)
_of_kind(
    "c02_allowed_values",
    [
        _violation_sql(
            t,
            "allowed_values",
            c,
            f"SELECT COUNT(*) FILTER (WHERE {c} NOT IN ({', '.join(map(_quote, v))})) FROM faulty_{t}",
        )
        for (t, c), v in ALLOWED_VALUES.items()
    ],
)
_of_kind(
    "c03_unique",
    [
        _violation_sql(
            t,
            "unique",
            c,
            f"SELECT COUNT(*) FROM (SELECT {c} FROM faulty_{t} WHERE {c} IS NOT NULL GROUP BY {c} "
            "HAVING COUNT(*) > 1) AS repeated",
        )
        for t, c in UNIQUE_KEYS
        if t in _bound_names()
    ],
)
_of_kind(
    "c04_foreign_key",
    [
        _violation_sql(
            t,
            "foreign_key",
            c,
            f"SELECT COUNT(*) FROM faulty_{t} AS ch LEFT JOIN faulty_{p} AS pa ON pa.id = ch.{c} "
            f"WHERE ch.{c} IS NOT NULL AND pa.id IS NULL",
        )
        for t, c, p in FOREIGN_KEYS
        if t in _bound_names() and p in _bound_names()
    ],
)
_of_kind(
    "c05_derived_total",
    [
        _violation_sql(
            h,
            "derived_total",
            total,
            f"SELECT COUNT(*) FROM faulty_{h} AS h LEFT JOIN (SELECT {key}, SUM({amount}) AS s "
            f"FROM faulty_{lines} GROUP BY {key}) AS l ON l.{key} = h.id "
            f"WHERE ABS(h.{total} - COALESCE(l.s, 0)) > {integrity.TOTAL_TOLERANCE}",
        )
        for h, lines, key, amount, total in DERIVED_TOTALS
        if lines in _bound_names()
    ],
)
