"""What is done once, whatever asks for it."""

import re
from datetime import datetime
from decimal import ROUND_HALF_EVEN, Decimal
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fleetlens.functions.numbers import half_even_2
from fleetlens.llm import bpe, token_counts, toxicity
from fleetlens.llm.queries import tokenizer_path
from fleetlens.operators import compare, tolerant
from fleetlens.registry.operators import _pairs, _stored_pairs
from fleetlens.sources.binding import bind, bind_once
from fleetlens.sources.checkpoints import checkpoint_dir
from fleetlens.sources.results import GENERATED, ROW_SCHEMA, TRUTH
from fleetlens.sources.runner import QueryRunner


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    """A few rows of every table; line 2 comes twice, and one customer has no order."""
    folder = tmp_path_factory.mktemp("warehouse")
    day = datetime(2001, 3, 4)
    tables = {
        "nation": ([(1, "PERU", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(1, "AMERICA")], "r_regionkey int, r_name string"),
        "supplier": ([(1, "s1", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": (
            [(1, "c1", 1, "BUILDING", 900.0), (2, "c2", None, None, -1.0)],
            "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double",
        ),
        "part": (
            [(5, "p5", "b", 10.0, "PROMO")],
            "p_partkey long, p_name string, p_brand string, p_retailprice double, p_type string",
        ),
        "orders": (
            [(7, 1, day, 9.5, "F", "1-URGENT")],
            "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, "
            "o_orderstatus string, o_orderpriority string",
        ),
        "lineitem": (
            [(7, 1, 5, 1.0, 10.0, day, "O"), (7, 2, 5, 1.0, 10.0, day, "F")] * 2,
            "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, "
            "l_extendedprice double, l_shipdate timestamp, l_linestatus string",
        ),
        "events": (
            [(3, 1, day, "click", 2.0)],
            "event_id long, user_id long, ts timestamp, event_type string, value double",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def files(spark):
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    return sorted(str(p) for p in folder.glob("bound-*/*/part-*"))


def test_joined_tables_are_derived_once_for_all_sessions(spark, warehouse):
    open_tables = bind_once(spark, warehouse)
    expected = {name: sorted(map(str, df.collect())) for name, df in bind(spark, warehouse).items()}
    first = dict(open_tables(spark.newSession()).items())
    written = files(spark)
    second = dict(open_tables(spark.newSession()).items())
    assert files(spark) == written != []
    for tables in (first, second):
        assert {n: sorted(map(str, df.collect())) for n, df in tables.items()} == expected
        for name in ("customers", "machines", "service_contracts"):
            assert "Join" not in tables[name]._jdf.queryExecution().optimizedPlan().toString()
    assert len(expected["machines"]) == 2


def test_texts_of_one_statement_run_once(spark, warehouse, tmp_path):
    runner = QueryRunner(spark, bind_once(spark, warehouse))
    texts = ["SELECT name FROM customers", " SELECT name FROM customers;\n"]
    entries = [("m", i, side, texts[i]) for i, side in enumerate(("gt", "gen"))]
    outcomes, rows = runner.store(entries, str(tmp_path))
    assert len(list(tmp_path.glob("run-*/rows/result=*"))) == 1
    assert outcomes.filter("ok").count() == 2 and rows.count() == 4


def test_rows_of_a_pair_are_grouped_by_many_tasks(spark):
    results = [
        (1, spark.range(50).selectExpr("concat('k', id) AS name"),
         spark.range(40).selectExpr("concat('k', id) AS name", "id AS more"))
    ]
    outcomes, rows = _stored_pairs(spark, results)
    scored = compare.score_pairs(outcomes, rows, training=True)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(model#\d+, query_id#\d+, signature", plan)
    assert [(r["matched"], r["result_match"]) for r in scored.collect()] == [(40, 0.5)]


def test_fitting_holds_four_bytes_a_coordinate():
    assert toxicity.coordinates("some words of a text").dtype == np.int32
    texts, labels = ["bad word here", "good text there"] * 40, [1, 0] * 40
    one = toxicity.fit(texts, labels)
    halves = [pa.RecordBatch.from_pydict({"text": texts[i : i + 40], "label": labels[i : i + 40]})
              for i in (0, 40)]
    (found,) = toxicity._fit_batches(iter(halves))
    assert found.column(0).to_pylist() == one[0].tolist() != []
    assert found.column(1).to_pylist() == one[1].tolist()


def test_workers_keep_no_hashes_after_a_task():
    batch = pa.RecordBatch.from_pydict({"text": ["bad word", "good text"] * 40, "label": [1, 0] * 40})
    assert list(toxicity._fit_batches(iter([batch])))
    assert not toxicity._HASHES


def test_encoded_texts_are_handed_on_before_the_batch_ends(spark):
    rows = [(i, ("some words of a text " * 5000) if i % 10 else None) for i in range(30)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    encoded = bpe.encode_documents(docs, tokenizer_path(), results=("n_tokens", "ids"))

    found = encoded.select("id", "n_tokens", F.size("ids").alias("n_ids")).collect()
    assert {r["id"]: r["n_tokens"] for r in found} == {i: 25_000 if t else 0 for i, t in rows}
    assert all(r["n_tokens"] == r["n_ids"] for r in found)
    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    parts = list(bpe._parts(batch, 1))
    assert len(parts) >= 3 and max(p.column(1).nbytes for p in parts) < 2 * bpe.PART_BYTES
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in bpe._parts(batch.slice(0, 0), 1)] == [0]


def test_parts_of_a_word_are_counted_once():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        source = file.read()
    counter = token_counts.PrefixCounter(source)
    library = sentencepiece.SentencePieceProcessor(model_proto=source)
    counted = []
    word, counter.word = counter.word, lambda part: (counted.append(part), word(part))[1]
    cut = next(a + b for a in "xyz" for b in "qjk" if a + b not in counter.joins)
    for text in (f"the{cut}then", f"then{cut}the", f"{cut}{cut} é{cut}\U00012000{cut}", "plain"):
        table = np.frombuffer(counter.table(text), np.int8)
        assert sum(table) == len(library.encode(text)) and len(table) == len(text)
    assert len(counted) == len(set(counted)) and not any(cut in part for part in counted)


def test_neighbours_are_told_from_the_steps_of_their_pieces():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        source = file.read()
    counter = token_counts.PrefixCounter(source)
    asked, merged = [], counter.merged
    counter.merged = lambda text, *more: (asked.append(text), merged(text, *more))[1]
    counter.table("their own words, newly joined, and unjoinable thenthethatof")
    assert all(text in counter.score or len(text) == 1 for text in asked)
    assert len(asked) == len(set(asked))
    rng = np.random.default_rng(7)
    short = [i for i in range(1, len(counter.pieces)) if len(counter.pieces[i]) < 4]
    pairs = [*rng.integers(1, len(counter.pieces), (2000, 2)), *rng.choice(short, (4000, 2))]
    found = []
    for before, last in pairs:
        pair = [counter.piece(before), counter.piece(last)]
        found.append(counter._may_stand(int(before), int(last)))
        assert found[-1] == (merged("".join(pair)) == pair)
    assert {True, False} == set(found)


def test_result_rows_are_compared_without_writing_their_cells(spark, warehouse):
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    outcomes, rows = _pairs(spark, warehouse)
    assert set(folder.rglob("part-*")) == before
    assert rows.count() == 10 and outcomes.count() == 12  # one order, kept by four copies


def test_signatures_are_no_longer_than_short_texts(spark):
    texts = ["x", "a,1:b", "1:x", None, "s" * 27, "s" * 28, "s" * 80, "é" * 14, "s" * 27]
    cells = [("null" if t is None else "str", None, t) for t in texts]
    rows = spark.createDataFrame(
        [("m", 1, TRUTH, i, [c, ("num", 2.0, None)]) for i, c in enumerate(cells)], ROW_SCHEMA
    ).selectExpr("*", "array(struct(0 AS gt_index, 0 AS gen_index)) AS mapping")
    found = compare._matchable(rows, exact=False).orderBy("row_no").collect()
    signatures = [bytes(r["signature"]) for r in found]
    sizes = [len(s) for s in signatures]
    assert sizes == [3, 7, 5, 4, 30, 31, 32, 31, 30]
    assert signatures[4] == signatures[8] and len(set(signatures)) == len(texts) - 1
    assert [r["pattern"] for r in found[2:4]] == ["str", "null"]


def test_blocks_are_sized_without_arrays(spark):
    data = [
        ("alone", TRUTH, [1.0]), ("alone", GENERATED, [1.01]),
        ("apart", TRUTH, [1.0]), ("apart", GENERATED, [3.0]),
        ("texts", TRUTH, []), ("texts", TRUTH, []), ("texts", GENERATED, []),
        ("near", TRUTH, [100.0]), ("near", TRUTH, [101.0]), ("near", GENERATED, [101.5]),
        ("mixed", TRUTH, [1.0]), ("mixed", TRUTH, [9.0]), ("mixed", GENERATED, [9.0]),
        ("wide", TRUTH, [1.0, 2.0]), ("wide", GENERATED, [1.0, 2.01]),
        ("one side", TRUTH, [1.0]),
    ]
    rows = spark.createDataFrame(
        [("p", s, side, i, n) for i, (s, side, n) in enumerate(data)],
        "pair string, signature string, side string, row_no long, numbers array<double>",
    )
    sizes = tolerant._sizes(rows, ["pair", "signature"])
    assert not [c for c, kind in sizes.dtypes if "array" in kind]
    found = {r["signature"]: (r["width"], r["simple"], r["served"]) for r in sizes.collect()}
    assert found == {
        "alone": (1, True, 1), "apart": (1, True, 0), "texts": (0, True, 1), "near": (1, True, 1),
        "mixed": (1, False, None), "wide": (2, True, 1),
    }


def test_rounding_away_from_ties_is_the_number_format(spark):
    rng = np.random.default_rng(5)
    values = [2.675, -2.675, 0.125, 0.375, -0.001, 1e9, 999999999.995, -123456789.125, 1e15]
    values += [float(v) for k in range(-3, 13) for v in rng.normal(0, 10.0**k, 50)]
    column = half_even_2(F.col("v"))
    plan = spark.createDataFrame([(v,) for v in values], "v double").select("v", column.alias("r"))
    assert "rint" in plan._jdf.queryExecution().optimizedPlan().toString().lower()
    for row in plan.collect():
        exact = Decimal(row["v"]).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
        assert str(row["r"]) == str(float(exact) + 0.0)
