"""Stored result sets, and the per-model score files.

A stored result set has two parts.  `outcomes` holds one row per (model, query, side):
whether it ran, the error, and the column names, which an empty result still has.
`rows` holds one row per result row, with typed cells by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.numbers import half_even_2

TRUTH, GENERATED = "gt", "gen"
EXACT_DOUBLE = 2**53  # a double holds every whole number up to here

OUTCOME_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType(), False),
        T.StructField("query_id", T.IntegerType(), False),
        T.StructField("side", T.StringType(), False),
        T.StructField("ok", T.BooleanType(), False),
        T.StructField("error", T.StringType(), True),
        T.StructField("columns", T.ArrayType(T.StringType(), False), False),
    ]
)

CELLS_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType(), False),
            T.StructField("num", T.DoubleType(), True),
            T.StructField("str", T.StringType(), True),
        ]
    ),
    False,
)
ROW_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType(), False),
        T.StructField("query_id", T.IntegerType(), False),
        T.StructField("side", T.StringType(), False),
        T.StructField("row_no", T.LongType(), False),
        T.StructField("cells", CELLS_TYPE, False),
    ]
)

QUERY_RESULT = T.StructType(
    [
        T.StructField("query_id", T.IntegerType(), False),
        T.StructField("question", T.StringType(), True),
        T.StructField("difficulty", T.StringType(), True),
        T.StructField("ground_truth_sql", T.StringType(), True),
        T.StructField("generated_sql", T.StringType(), True),
        T.StructField("execution_success", T.BooleanType(), False),
        T.StructField("execution_error", T.StringType(), True),
        T.StructField("ground_truth_row_count", T.LongType(), True),
        T.StructField("generated_row_count", T.LongType(), True),
        T.StructField("result_match", T.DoubleType(), True),
    ]
)
BENCHMARK_RESULT = T.StructType(
    [
        T.StructField("model_name", T.StringType(), False),
        T.StructField("timestamp", T.StringType(), True),
        T.StructField("total_queries", T.LongType(), False),
        T.StructField("execution_accuracy", T.DoubleType(), True),
        T.StructField("result_match_avg", T.DoubleType(), True),
        T.StructField("results", T.ArrayType(QUERY_RESULT), False),
    ]
)


def _comparable(field: T.StructField, number: Column) -> Column:
    fractional = isinstance(field.dataType, (T.FractionalType, T.DecimalType))
    return half_even_2(number) if fractional else number


def _cell(field: T.StructField, column: Column) -> Column:
    """kind is null, num or str.  Numbers of every width become doubles rounded to two
    places, the precision at which results are compared.  A number beyond the whole numbers
    that a double holds keeps its exact digits besides, as far as 38 of them.  A value that
    is not finite keeps its text, so it only equals itself."""
    numeric = isinstance(field.dataType, (T.NumericType, T.BooleanType))
    number = column.cast("double") if numeric else F.lit(None).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    is_number = finite if numeric else F.lit(False)
    text = column.cast("string")
    exact = F.lit(None).cast("string")
    if numeric and not isinstance(field.dataType, T.BooleanType):
        wide = is_number & (F.abs(number) > EXACT_DOUBLE) & (F.abs(number) < 1e38)
        exact = F.when(wide, column.cast("decimal(38,0)").cast("string"))
    return F.struct(
        F.when(column.isNull(), "null").when(is_number, "num").otherwise("str").alias("kind"),
        F.when(is_number, _comparable(field, number)).alias("num"),
        F.when(column.isNotNull() & ~is_number, text).otherwise(exact).alias("str"),
    )


def result_rows(df: DataFrame, model: str, query_id: int, side: str) -> DataFrame:
    """A query result as stored rows.

    row_no follows the order of the result: ids grow along a partition and from one
    partition to the next.  It need not be dense."""
    # Positional names, because a result may repeat a column name.
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cells = [_cell(field, F.col(f"c{i}")) for i, field in enumerate(df.schema.fields)]
    return plain.select(
        F.lit(model).alias("model"),
        F.lit(query_id).cast("int").alias("query_id"),
        F.lit(side).alias("side"),
        F.monotonically_increasing_id().alias("row_no"),
        F.array(*cells).cast(CELLS_TYPE).alias("cells"),
    )


def outcome_row(
    model: str, query_id: int, side: str, columns: list[str], error: str | None = None
) -> tuple:
    return (model, query_id, side, error is None, error, list(columns))


def outcome_table(spark: SparkSession, outcomes: list[tuple]) -> DataFrame:
    """One row per executed query text; the list comes from the driver's own calls."""
    return spark.createDataFrame(outcomes, OUTCOME_SCHEMA)


def file_label(model: Column) -> Column:
    return F.concat(F.lit("results_"), F.translate(model, ".", "_"))


def write_score_files(scored: DataFrame, directory: str, mode: str = "error") -> None:
    """Scored results (model_name and the QUERY_RESULT columns) as JSON lines, in one
    folder per model named after it with dots replaced.  A model's results are written
    by as many tasks as hold them."""
    columns = ["model_name", *QUERY_RESULT.names]
    labelled = scored.select(*columns, file_label(F.col("model_name")).alias("file"))
    labelled.write.mode(mode).partitionBy("file").json(directory)


def read_score_files(spark: SparkSession, directory: str) -> DataFrame:
    """All models' results, one row per (model, query)."""
    schema = T.StructType([BENCHMARK_RESULT["model_name"], *QUERY_RESULT.fields])
    return spark.read.schema(schema).json(f"{directory}/file=results_*")


def write_score_documents(benchmark: DataFrame, directory: str, mode: str = "error") -> None:
    """One JSON document per model that holds all its results; see
    `plans.scoreboard.benchmark_records`."""
    labelled = benchmark.withColumn("file", file_label(F.col("model_name")))
    labelled.write.mode(mode).partitionBy("file").json(directory)


def read_score_documents(spark: SparkSession, paths: str) -> DataFrame:
    """Results of documents that hold one model each, indented or not, one row per
    (model, query).  Documents that keep result rows instead of their number are
    counted here."""
    row_lists = [
        T.StructField(name, T.ArrayType(T.ArrayType(T.StringType())))
        for name in ("ground_truth_rows", "generated_rows")
    ]
    result = T.ArrayType(T.StructType([*QUERY_RESULT.fields, *row_lists]))
    schema = T.StructType([*BENCHMARK_RESULT.fields[:-1], T.StructField("results", result)])
    per_query = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(paths)
        .select("model_name", "timestamp", "total_queries", F.explode("results").alias("r"))
        .select("model_name", "timestamp", "total_queries", "r.*")
    )
    counted = {
        f"{side}_row_count": F.coalesce(f"{side}_row_count", F.size(f"{side}_rows"))
        for side in ("ground_truth", "generated")
    }
    return per_query.withColumns(counted).drop(*[f.name for f in row_lists])
