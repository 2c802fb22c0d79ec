"""Quality and toxicity: held-out accuracy and odd inputs."""

import zlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import quality, queries, toxicity
from fleetlens.llm.labelled import labelled_sample, remainder

LARGE = "/root/testdata/sf0.1"


def confusion(spark, query, label, held_out):
    rows = query(spark, LARGE)
    truth = spark.read.parquet(f"{LARGE}/labels.parquet")
    counted = (
        rows.join(truth, "doc_id").filter("held_out").groupBy(label, "predicted").count().collect()
    )
    total = rows.count()
    assert total == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    for r in rows.limit(50).collect():
        assert r["held_out"] == held_out(zlib.crc32(str(r["doc_id"]).encode()))
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    return {(r[label], r["predicted"]): r["count"] for r in counted}


def test_quality_held_out(spark):
    n = confusion(spark, queries.op2_quality, "quality", lambda c: c % 5 == 0)
    assert n[(1, 1)] / (n[(1, 1)] + n.get((1, 0), 0)) > 0.98
    assert n[(0, 0)] / (n[(0, 0)] + n[(0, 1)]) > 0.7


def test_toxicity_held_out(spark):
    n = confusion(spark, queries.op6_toxicity, "toxic", lambda c: c % 4 == 2)
    assert n[(0, 0)] / (n[(0, 0)] + n.get((0, 1), 0)) > 0.99
    assert n[(1, 1)] / (n[(1, 1)] + n[(1, 0)]) > 0.7


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(60)] + [(4, 1, 1), (None, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def taught(spark):
    rows = [
        (i, ("awful clown " if i % 2 else "kind person ") + f"said {i} times " * 20)
        for i in range(60)
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_odd_rows(odd, empty, taught, labels, kind):
    learn = remainder("doc_id", 5) != 0
    model = kind.fit_model(taught, labels, learn)
    for docs in (odd, empty):
        scored = docs.select("doc_id", "text", kind.score(model, "text").alias("score")).collect()
        assert len(scored) == docs.count()
        assert all(0 <= r["score"] <= 1 for r in scored)
        by_text = {}
        for r in scored:
            assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]


@pytest.mark.parametrize(("kind", "score"), [(quality, 0.5), (toxicity, 0.0)])
def test_nothing_to_learn(odd, taught, labels, kind, score):
    one_kind = labels.filter("quality = 1")
    model = kind.fit_model(taught, one_kind, F.lit(True))
    scores = odd.select(kind.score(model, "text").alias("s")).distinct().collect()
    assert [r["s"] for r in scores] == [score]


def test_fit_repeats(taught, labels):
    learn = remainder("doc_id", 5) != 0
    assert toxicity.fit_model(taught, labels, learn) == toxicity.fit_model(taught, labels, learn)
    assert quality.fit_model(taught, labels, learn) == quality.fit_model(taught, labels, learn)


def test_sample_is_bounded_and_skips_held_out(taught, labels):
    learn = remainder("doc_id", 5) != 0
    rows = labelled_sample(taught.union(taught), labels, "toxic", learn, bound=10).collect()
    assert len(rows) == 10
    assert all(zlib.crc32(str(r["key"]).encode()) % 5 for r in rows)
    assert {r["key"]: r["label"] for r in rows if r["key"] == 4} in ({}, {4: 1})


def test_more_than_one_toxic_word_counts(spark):
    at, weight = toxicity.fit(
        ["you clown", "you idiot", "you friend", "a friend"] * 60, [1, 1, 0, 0] * 60
    )
    assert len(at) < 20
    model = list(zip(at.tolist(), weight.tolist(), strict=True))
    df = spark.createDataFrame([("you clown you idiot",), ("a friend",)], "text string")
    high, low = [r[0] for r in df.select(toxicity.score(model, "text")).collect()]
    assert high > 0.8 > 0.2 > low
