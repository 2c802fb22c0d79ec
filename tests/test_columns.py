"""Column functions against plain Python."""

import random
import re
from datetime import date

from pyspark.sql import functions as F

from fleetlens.functions import dates, text
from fleetlens.functions.numbers import half_even_2, ratio


def column(spark, values, kind, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_half_even_like_python_round(spark):
    rng = random.Random(3)
    values = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 0.0, -0.001, 1e12 + 0.125, 123456789.995]
    values += [k / 1000 for k in range(-3000, 3000, 5)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(3000)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 15) for _ in range(3000)]
    got = column(spark, values, "double", half_even_2)
    assert [v for v, g in zip(values, got) if round(v, 2) + 0.0 != g] == []


def test_half_even_keeps_null(spark):
    assert column(spark, [None], "double", half_even_2) == [None]


def test_ratio_of_zero_is_null(spark):
    assert column(spark, [0, 4], "int", lambda c: ratio(F.lit(2), c)) == [None, 0.5]


def expected_sql(raw):
    """The cleaning rules, said in Python."""
    if not raw:
        return ""
    spoken = "".join(re.split(r"(?s)<think>.*?</think>", raw)).strip()
    fence = re.search(r"(?s)```(?:sql)?\s*\n?(.*?)```", spoken)
    body = (fence.group(1) if fence else spoken).strip()
    head, mark, _ = body.partition(";")
    return head + mark


def test_extract_sql(spark):
    pieces = ["<think>", "</think>", "```sql\n", "```", ";", " SELECT 1 ", "\n", "text", " ", "\t", "sql", "``"]
    rng = random.Random(11)
    raws = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    raws += ["SELECT ';' AS a", "```\nSELECT 1;\nSELECT 2;\n```", "<think>\na;\n</think>\nSELECT 1"]
    assert column(spark, raws, "string", text.extract_sql) == [expected_sql(r) for r in raws]
    assert column(spark, [None, ""], "string", text.extract_sql) == ["", ""]


def test_starts_with_select(spark):
    given = [" select 1", "WITH a AS (SELECT 1) SELECT 1", "", "SELECTED"]
    assert column(spark, given, "string", text.starts_with_select) == [True, False, False, True]


def test_canonical_names(spark):
    given = ["Customer_Name", "total_id", "total_", "product_abc", " Account_Manager_name ", "name"]
    wanted = ["name", "total_id", "total_", "abc", "name", "name"]
    assert column(spark, given, "string", text.canonical_name) == wanted


def test_labels_and_cuts(spark):
    assert column(spark, [7, 12345], "bigint", lambda c: text.padded_label("SN-", 4, c)) == [
        "SN-0007", "SN-12345",
    ]
    assert column(spark, ["abcdef"], "string", lambda c: text.shorten(c, 3)) == ["abc"]


def test_dates(spark):
    assert dates.days_before(date(2026, 3, 4), 180) == date(2025, 9, 5)
    assert dates.months_before(date(2026, 3, 4), 6) == date(2025, 9, 4)
    assert dates.months_before(date(2026, 8, 31), 6) == date(2026, 2, 28)
    assert dates.months_before(date(2026, 1, 15), 12) == date(2025, 1, 15)
    days = [date(2025, 12, 31), date(2026, 1, 1), date(2026, 12, 31), date(2027, 1, 1)]
    assert column(spark, days, "date", lambda c: dates.in_year(c, 2026)) == [False, True, True, False]
    assert column(spark, days, "date", lambda c: dates.quarter_label("v")) == [
        "2025-Q4", "2026-Q1", "2026-Q4", "2027-Q1",
    ]
    assert column(spark, days[:2], "date", lambda c: dates.month_label("v")) == ["2025-12", "2026-01"]
