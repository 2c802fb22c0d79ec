import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.operators.numbering import row_number_within
from fleetlens.operators.ranking import (
    global_ntile,
    global_rank,
    global_row_number,
    latest_per_key,
)


@pytest.fixture(scope="module", params=["ties", "mostly_one_value", "nulls", "few"])
def values(spark, request):
    rng = random.Random(7)
    n = 3 if request.param == "few" else 1000
    pick = {
        "ties": lambda: float(rng.randint(0, 40)),
        "mostly_one_value": lambda: 5.0 if rng.random() < 0.6 else rng.random() * 10,
        "nulls": lambda: None if rng.random() < 0.4 else float(rng.randint(0, 9)),
        "few": lambda: 1.0,
    }[request.param]
    data = [(i, pick()) for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "id bigint, v double").repartition(5)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("descending", [False, True])
def test_like_plain_windows(values, descending):
    first = F.desc_nulls_last("v") if descending else F.asc_nulls_first("v")
    whole = W.orderBy(first, "id")
    for got, expected in (
        (global_row_number(values, "v", "id", "x", descending), F.row_number().over(whole)),
        (global_ntile(values, "v", "id", 5, "x", descending), F.ntile(5).over(whole)),
        (global_ntile(values, "v", "id", 7, "x", descending), F.ntile(7).over(whole)),
        (global_rank(values, "v", "id", "x", descending), F.rank().over(W.orderBy(first))),
    ):
        same(got.select("id", "x"), values.select("id", expected.alias("x")))


def test_numbers_within_groups_of_any_size(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 0, id % 50) AS g", "-id AS o")
    plain = F.row_number().over(W.partitionBy("g").orderBy("o")) - 1
    got = row_number_within(rows, ["g"], "o", "place")
    same(got.select("id", "place"), rows.select("id", plain.alias("place")))


def test_latest_per_key(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 5, 0), (1, 4, 2), (2, 1, 9)], "k int, d int, i int")
    got = latest_per_key(rows, "k", [F.desc("d"), F.asc("i")])
    assert sorted(map(tuple, got.collect())) == [(1, 5, 0), (2, 1, 9)]
