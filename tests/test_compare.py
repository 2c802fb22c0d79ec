"""The comparer: a table of cases, parity with plain first fit, and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import compare, tolerant
from fleetlens.operators import first_fit as kernels
from fleetlens.operators.first_fit import first_fit
from fleetlens.sources.results import (
    CELLS_TYPE,
    GENERATED,
    ROW_SCHEMA,
    TRUTH,
    outcome_row,
    outcome_table,
    result_rows,
)


def cell(value):
    if value is None:
        return ("null", None, None)
    if isinstance(value, (int, float)):
        return ("num", float(value), None)
    return ("str", None, value)


def score(spark, cases, training=False):
    """cases: list of (gt_columns, gt_rows, gen_columns, gen_rows) -> verdicts."""
    outcomes, rows = [], []
    for number, (gt_columns, gt_rows, gen_columns, gen_rows) in enumerate(cases):
        for side, columns, data in ((TRUTH, gt_columns, gt_rows), (GENERATED, gen_columns, gen_rows)):
            outcomes.append(outcome_row("m", number, side, columns))
            rows += [
                ("m", number, side, i, [cell(v) for v in row]) for i, row in enumerate(data)
            ]
    scored = compare.score_pairs(
        outcome_table(spark, outcomes),
        compare.normalised(spark.createDataFrame(rows, ROW_SCHEMA)),
        training,
    )
    return {r["query_id"]: r for r in scored.collect()}


CASES = [
    # (what, gt columns, gt rows, gen columns, gen rows, verdict, training verdict)
    ("both empty", ["a"], [], ["b"], [], 1.0, 1.0),
    ("truth empty", ["a"], [], ["a"], [(1,)], 0.0, 0.0),
    ("generated empty", ["a"], [(1,)], ["a"], [], 0.0, 0.0),
    ("same", ["a"], [(1,), (2,)], ["a"], [(2,), (1,)], 1.0, 1.0),
    ("names ignored when all rows agree", ["a"], [(1,)], ["z"], [(1,)], 1.0, 1.0),
    ("no column in common", ["a"], [(1,)], ["z"], [(2,)], 0.0, 0.0),
    ("columns in another order", ["a", "b"], [(1, "x")], ["B", "A"], [("x", 1)], 1.0, 1.0),
    ("extra column", ["a"], [("x",)], ["a", "b"], [("x", 9)], 1.0, 1.0),
    ("prefix", ["name"], [("x",)], ["customer_name", "n"], [("x", 1)], 1.0, 0.0),
    ("prefix both ways", ["total_value"], [("x",)], ["n", "value"], [(1, "x")], 1.0, 0.0),
    ("prefix too short", ["id"], [("x",)], ["customer_id", "n"], [("x", 1)], 0.0, 0.0),
    ("rounded", ["a"], [(1.004,)], ["a"], [(1.001,)], 1.0, 1.0),
    ("integer and float", ["a"], [(1,)], ["a"], [(1.0,)], 1.0, 1.0),
    ("within tolerance", ["a"], [(100.0,)], ["a"], [(101.5,)], 1.0, 0.0),
    ("outside tolerance", ["a"], [(100.0,)], ["a"], [(103.0,)], 0.0, 0.0),
    ("absolute below one", ["a"], [(0.01,)], ["a"], [(0.02,)], 1.0, 0.0),
    ("null equals null", ["a", "b"], [(None, 100.0)], ["a", "b"], [(None, 101.0)], 1.0, 0.0),
    ("null is not zero", ["a"], [(None,)], ["a"], [(0,)], 0.0, 0.0),
    ("number is not text", ["a"], [(1,)], ["a"], [("1",)], 0.0, 0.0),
    ("text is case sensitive", ["a"], [("x",)], ["a"], [("X",)], 0.0, 0.0),
    ("extra rows are free", ["a"], [("x",)], ["a"], [("x",), ("y",)], 1.0, 0.5),
    ("two of three", ["a"], [("x",), ("y",), ("z",)], ["a"], [("x",), ("y",)], 0.5, 0.5),
    ("exactly half", ["a"], [("x",), ("y",)], ["a"], [("x",)], 0.0, 0.0),
    ("duplicates need partners", ["a"], [("x",), ("x",), ("x",)], ["a"], [("x",)], 0.0, 0.5),
    ("first fit is greedy", ["a"], [(100,), (103,)], ["a"], [(101.5,), (100,)], 0.0, 0.0),
    ("same name twice", ["a", "a"], [("x", "y")], ["a", "b"], [("x", "q")], 1.0, 1.0),
    ("edge space in names", ["a"], [("x",)], [" a ", "b"], [("x", 1)], 1.0, 1.0),
]


@pytest.mark.parametrize("training", [False, True])
def test_table_of_cases(spark, training):
    got = score(spark, [c[1:5] for c in CASES], training)
    expected = {c[0]: c[6 if training else 5] for c in CASES}
    assert {c[0]: got[i]["result_match"] for i, c in enumerate(CASES)} == expected


def test_failures(spark):
    outcomes = outcome_table(
        spark,
        [
            outcome_row("m", 1, TRUTH, ["a"]),
            outcome_row("m", 1, GENERATED, [], "no such column"),
            outcome_row("m", 2, TRUTH, [], "broken"),
            outcome_row("m", 2, GENERATED, ["a"]),
        ],
    )
    rows = spark.createDataFrame([("m", 1, TRUTH, 0, [cell(1)])], ROW_SCHEMA)
    got = {r["query_id"]: r for r in compare.score_pairs(outcomes, rows).collect()}
    assert (got[1]["execution_success"], got[1]["result_match"]) == (False, 0.0)
    assert got[1]["execution_error"] == "no such column"
    assert (got[2]["gt_error"], got[2]["result_match"]) == ("broken", None)


def close(a, b):
    if len(a) != len(b):
        return False
    return all(abs(x - y) <= max(abs(x), abs(y), 1) * 0.02 for x, y in zip(a, b))


def slow_first_fit(truth, generated):
    taken, pairs = set(), []
    for i, a in enumerate(truth):
        for j, b in enumerate(generated):
            if j not in taken and close(a, b):
                taken.add(j)
                pairs.append((i, j))
                break
    return pairs


def random_rows(rng, n, width, values):
    return [tuple(rng.choice(values) * rng.uniform(0.97, 1.03) for _ in range(width)) for _ in range(n)]


def test_kernel_like_plain_first_fit():
    rng = random.Random(5)
    for _ in range(1500):
        width = rng.randint(1, 3)
        values = rng.choice([(1, 100), (0.1, -0.1, 0.5), (1000,), (-5, 5, 6), (1e9, 1e-9)])
        truth = random_rows(rng, rng.randint(1, 12), width, values)
        generated = random_rows(rng, rng.randint(1, 12), width, values)
        assert first_fit(np.array(truth), np.array(generated)) == slow_first_fit(truth, generated)


def pairs_input(spark, cases):
    """cases: list of (truth, generated), rows being (text, *numbers)."""
    rows = []
    for pair, sides in enumerate(cases):
        for side, data in zip((TRUTH, GENERATED), sides):
            rows += [
                (pair, side, i * 7, row[0], "str" + ",num" * (len(row) - 1), list(row[1:]))
                for i, row in enumerate(data)
            ]
    return spark.createDataFrame(
        rows,
        "pair int, side string, row_no bigint, signature string, pattern string, "
        "numbers array<double>",
    ).repartition(4)


def slow_counts(cases):
    def one(truth, generated):
        total = 0
        for key in {r[0] for r in truth}:
            mine = [r[1:] for r in truth if r[0] == key]
            theirs = [r[1:] for r in generated if r[0] == key]
            total += len(slow_first_fit(mine, theirs))
        return total

    return {i: one(*case) for i, case in enumerate(cases)}


def random_cases(rng, n, rows):
    cases = []
    for _ in range(n):
        width = rng.randint(0, 2)
        values = rng.choice([(1, 100), (0.1, -0.1, 0.5), (1000,), (10, 11, 12, 13, 14)])
        make = lambda: [
            (rng.choice("ab"), *r) for r in random_rows(rng, rng.randint(1, rows), width, values)
        ]
        cases.append((make(), make()))
    return cases


def counts(spark, cases):
    got = tolerant.tolerant_match_counts(pairs_input(spark, cases)).collect()
    found = {r["pair"]: r["matched"] for r in got}
    return {i: found.get(i, 0) for i in range(len(cases))}


@pytest.mark.parametrize("scale", [0.05, 1.0, 3.0, 1e6])
def test_one_number_like_plain_first_fit(scale):
    draw = np.random.default_rng(int(scale * 100))
    for _ in range(150):
        sides = []
        for _ in range(2):
            values = draw.normal(draw.choice([0, 1, 50, -1]), scale, draw.integers(1, 40))
            tied = draw.random(len(values)) < 0.4
            values[tied] = draw.choice([1.0, 1.02, 0.98, -1, 0, 50, 51], tied.sum())
            sides.append(values.reshape(-1, 1))
        assert first_fit(*sides) == slow_first_fit(*(x.tolist() for x in sides))


def test_a_dense_block_is_one_job_for_its_size(spark, monkeypatch):
    """Neither chunks nor diagonals for 30,000 rows a side; the same number as in chunks."""
    rows = spark.range(60_000).selectExpr(
        "'p' AS pair", "IF(id % 2 = 0, 'gt', 'gen') AS side", "id div 2 AS row_no", "'s' AS signature",
        "'num' AS pattern", "array(DOUBLE(pmod(hash(id), 200000) / 10000)) AS numbers",
    )
    chunks = tolerant._match_in_chunks
    monkeypatch.setattr(tolerant, "_match_in_chunks", None)
    found = tolerant.tolerant_match_counts(rows).first()["matched"]
    monkeypatch.setattr(tolerant, "_match_in_chunks", chunks)
    monkeypatch.setattr(tolerant, "DENSE_LIMIT", 10)
    assert tolerant.tolerant_match_counts(rows).first()["matched"] == found > 29_000


def test_blocks_of_one_number_of_any_size_go_without_chunks(spark, monkeypatch):
    rows = spark.range(520_000).selectExpr(
        "'p' AS pair", "IF(id % 2 = 0, 'gt', 'gen') AS side", "id div 2 AS row_no", "'s' AS signature",
        "'num' AS pattern", "array(DOUBLE(pmod(hash(id), 200000) / 10000)) AS numbers",
    )
    monkeypatch.setattr(tolerant, "_match_in_chunks", None)
    found = tolerant.tolerant_match_counts(rows).first()["matched"]
    sides = [
        np.array(
            [r["numbers"] for r in rows.filter(f"side = '{side}'").orderBy("row_no").collect()]
        )
        for side in (TRUTH, GENERATED)
    ]
    assert found == len(first_fit(*sides)) > 250_000


def test_a_side_held_in_parts_like_plain_first_fit(spark, monkeypatch):
    """Either side is the smaller one, and has many parts."""
    monkeypatch.setattr(tolerant, "BLOCK_LIMIT", 4)
    monkeypatch.setattr(tolerant, "DENSE_LIMIT", 30)
    for module in (tolerant, kernels):
        monkeypatch.setattr(module, "PACK_ROWS", 7)
    monkeypatch.setattr(tolerant, "_match_in_chunks", None)
    rng = random.Random(12)
    make = lambda n: [("k", round(rng.choice([50, 51.5, 49]) * rng.uniform(0.95, 1.05), 1)) for _ in range(n)]
    cases = [(make(n), make(m)) for n, m in ((90, 140), (140, 90), (65, 65), (6, 70), (1, 40))]
    assert counts(spark, cases) == slow_counts(cases)
    monkeypatch.setattr(tolerant, "DENSE_LIMIT", 1000)
    assert counts(spark, cases) == slow_counts(cases)


@pytest.mark.parametrize("scale", [0.02, 1.0, 40.0, 1e9])
def test_numbers_are_taken_alike_from_both_sides(scale, monkeypatch):
    draw = np.random.default_rng(3)
    for listed in [0, 100_000] * 30:
        monkeypatch.setattr(kernels, "LISTED", listed)
        a, b = (np.round(draw.normal(scale, scale, draw.integers(1, 300)), 2) for _ in range(2))
        edge = min(len(a), len(b)) // 3
        b[:edge] = a[:edge] / 0.98
        free = kernels.FreeNumbers(b)
        taken = [j for part in np.array_split(a, 4) for j in free.take(part)]
        found = [(i, j) for i, j in enumerate(taken) if j >= 0]
        assert found == slow_first_fit(a.reshape(-1, 1).tolist(), b.reshape(-1, 1).tolist())
        assert sorted((i, j) for j, i in kernels.first_fit_of_one(b, a)) == found


def test_ends_of_close_values_are_exact():
    draw = np.random.default_rng(4)
    asked = np.concatenate([draw.normal(0, s, 60) for s in (0.01, 1, 50, 1e6)] + [[0, 1, -1, 0.98, -0.98]])
    values = [asked, asked / 0.98, asked * 0.98, asked + 0.02, asked - 0.02]
    values += [np.nextafter(v, x) for v in values for x in (-np.inf, np.inf)]
    values = np.unique(np.concatenate(values))
    begin, end = kernels.close_ranges(values, asked)
    for a, low, high in zip(asked, begin, end):
        assert kernels.close_matrix(values, a).nonzero()[0].tolist() == list(range(low, high))


def test_blocks_like_plain_first_fit(spark):
    cases = random_cases(random.Random(8), 150, 9)
    assert counts(spark, cases) == slow_counts(cases)


def test_oversize_blocks_like_plain_first_fit(spark, monkeypatch):
    monkeypatch.setattr(tolerant, "BLOCK_LIMIT", 4)
    monkeypatch.setattr(tolerant, "CHUNK_ROWS", 5)
    cases = random_cases(random.Random(9), 25, 22)
    assert counts(spark, cases) == slow_counts(cases)


def test_alike_rows_need_no_python(spark):
    cases = [([("k", 5.0)] * 30, [("k", 5.0)] * 12)]
    assert counts(spark, cases) == {0: 12}


def test_one_number_within_the_tolerance_everywhere(spark, monkeypatch):
    """Hot values of any number are counted, not matched row by row."""
    cases = [
        ([("k", 50.0)] * 40, [("k", 50.5)] * 30),
        ([("k", -0.004), ("k", 0.01)] * 5, [("k", 0.0)] * 20),
        ([("k", -50.0)] * 3, [("k", -50.5), ("k", -49.9)]),
    ]
    monkeypatch.setattr(
        tolerant,
        "_one_call_each",
        lambda rows, sizes, keys: sizes.filter("NOT simple").selectExpr("pair", "-1L AS matched"),
    )
    assert counts(spark, cases) == {0: 30, 1: 10, 2: 2} == slow_counts(cases)


def test_close_values_never_lie_two_bins_apart(spark):
    rng = random.Random(4)
    values = [rng.uniform(-2, 2) * 10 ** rng.randint(-3, 8) for _ in range(4000)]
    pairs = []
    for v in values:
        w = v + rng.choice([-1, 1]) * 0.02 * max(abs(v), 1) * rng.uniform(0.9, 1.0204)
        if close((v,), (w,)):
            pairs.append((v, w))
    assert len(pairs) > 1500
    df = spark.createDataFrame(pairs, "v double, w double").select(
        F.abs(tolerant.tolerance_bin(F.col("v")) - tolerant.tolerance_bin(F.col("w"))).alias("gap")
    )
    assert df.agg(F.max("gap")).first()[0] <= 1


def test_extra_generated_rows_never_lower_a_verdict(spark):
    rng = random.Random(6)
    cases = []
    for _ in range(12):
        truth = [(rng.choice("xyz"), round(rng.uniform(1, 3), 1)) for _ in range(5)]
        generated = [(rng.choice("xyz"), round(rng.uniform(1, 3), 1)) for _ in range(5)]
        more = generated + [(rng.choice("xyz"), round(rng.uniform(1, 3), 1)) for _ in range(3)]
        cases += [(["k", "v"], truth, ["k", "v"], generated), (["k", "v"], truth, ["k", "v"], more)]
    got = score(spark, cases)
    for i in range(0, len(cases), 2):
        assert got[i + 1]["result_match"] >= got[i]["result_match"]


def test_result_rows_keep_order_and_kinds(spark):
    df = spark.sql(
        "SELECT id, CAST(id AS DECIMAL(9,2)) AS id, CAST(NULL AS STRING) AS n, "
        "DATE '2024-01-01' AS d, double('NaN') AS x FROM range(20)"
    ).orderBy("d")
    stored = result_rows(df, "m", 1, TRUTH)
    assert stored.schema["cells"].dataType == CELLS_TYPE
    first = stored.orderBy("row_no").first()["cells"]
    assert [c["kind"] for c in first] == ["num", "num", "null", "str", "str"]
    assert first[3]["str"] == "2024-01-01"
    assert stored.select("row_no").distinct().count() == 20


def test_bags_equal(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (1, "x")], "p int, q string")
    c = spark.createDataFrame([(2, "y"), (2, "y"), (1, "x")], "p int, q string")
    assert compare.bags_equal(a, b).first()["equal"]
    assert not compare.bags_equal(a, c).first()["equal"]


def test_large_whole_numbers_are_exact_in_training(spark):
    """Ids above 2^53 that differ by one are different rows; 2 % apart is near in scoring."""
    base = 2**60
    pairs = {1: base + 1, 2: base}
    outcomes, rows = [], None
    for number, other in pairs.items():
        for side, value in ((TRUTH, base), (GENERATED, other)):
            df = spark.createDataFrame([(value, "a")], "id long, name string")
            outcomes.append(outcome_row("m", number, side, df.columns))
            part = result_rows(df, "m", number, side)
            rows = part if rows is None else rows.unionByName(part)
    table = outcome_table(spark, outcomes)

    def verdicts(training):
        scored = compare.score_pairs(table, rows, training=training).collect()
        return {r["query_id"]: r["result_match"] for r in scored}

    assert verdicts(True) == {1: 0.0, 2: 1.0}
    assert verdicts(False) == {1: 1.0, 2: 1.0}


def test_sums_prove_bags_unequal(spark):
    """Only pairs that the signed hash sums leave open are grouped by their cells."""
    rng = random.Random(12)
    cases = []
    for _ in range(40):
        truth = [(rng.choice("xyz"), float(rng.randint(0, 2))) for _ in range(6)]
        generated = rng.sample(truth, len(truth))
        if rng.random() < 0.6:
            generated[0] = (rng.choice("xyz"), float(rng.randint(0, 2)))
        cases.append((truth, generated + truth[: rng.choice((0, 0, 1))]))
    cases.append(([("x", 0.0)], [("x", -0.0)]))
    cases.append(([("x", 1.0)] * 3 + [("y", 1.0)], [("x", 1.0)] + [("y", 1.0)] * 3))
    rows = spark.createDataFrame(
        [
            ("m", n, side, cells[0], [cells[1]])
            for n, case in enumerate(cases)
            for side, bag in zip((TRUTH, GENERATED), case)
            for cells in bag
        ],
        "model string, query_id int, side string, signature string, numbers array<double>",
    )
    compared = ("signature", "numbers")
    sums = rows.groupBy(*compare.PAIR).agg(*compare._bag_sums(*compared))
    expected = {n for n, (a, b) in enumerate(cases) if sorted(a) == sorted(b)}
    assert 0 < len(expected) < len(cases)
    assert {r["query_id"] for r in sums.filter("may_be_equal").collect()} == expected
    equal = compare._equal_bags(rows, sums, *compared)
    assert {r["query_id"] for r in equal.collect()} == expected
    # Sums that prove nothing leave the answer to the cells.
    open_sums = sums.withColumn("may_be_equal", F.lit(True))
    assert {r["query_id"] for r in compare._equal_bags(rows, open_sums, *compared).collect()} == expected
    # One row a pair leaves the map side: no cells in the exchange of the sums.
    plan = sums._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchange and not any("numbers" in line for line in exchange)
