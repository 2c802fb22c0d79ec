"""The registered queries over whole tables, and the pipeline stage by stage."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL, bag, spark_bag
from tests.llm.conftest import odd_rows

import __spark_entry__ as contract
import corpus_pipeline
from fleetlens.llm import queries

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


def test_all_are_offered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert spark_bag(df) == bag(columns, cursor.fetchall())


def test_simhash_equals_plain(spark):
    from tests.llm.test_simhash import plain_components, plain_print

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_print(r["text"]) for r in docs}
    root = plain_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for doc_id, p in prints.items():
        first[root[p]] = min(first.get(root[p], doc_id), doc_id)
    expected = [(i, f"{p:016x}", first[root[p]]) for i, p in prints.items()]
    assert sorted(map(tuple, queries.op1_simhash(spark, SMALL).collect())) == sorted(expected)


def test_mix_takes_no_row_thrice(spark):
    from fleetlens.llm import mixing

    rows = [(i, "two words" if i % 4 else "", "en", "abc"[min(i % 9, 2)], 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = mixing.mix(docs).groupBy("row.source").agg(
        F.max("times").alias("most"), F.max(F.col("target") / F.col("source_size")).alias("epochs")
    )
    assert all(r["most"] <= 2 for r in found.collect()) and found.filter("epochs = 2").count()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = sorted(r["doc_id"] for r in QUERIES[name](spark, SMALL).select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_tokens_equal_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for r in queries.op10_bpe(spark, SMALL).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False).encode()
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(said).hexdigest()


def test_fingerprints_tell_near_from_far(spark):
    row = queries.op3_fingerprints(spark, SMALL).agg(
        F.avg("near_edited").alias("edited"), F.avg("near_next").alias("next")
    )
    found = row.first()
    assert found["edited"] > 0.65 and found["next"] < 0.25


def test_pipeline_stages(spark):
    from tests.llm.test_simhash import plain_components, plain_print
    from tests.llm.test_text_operators import plain_lines

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near duplicates", "mix", "tokens"]

    def after(name, before):
        out = stages[name](spark, before, SMALL)
        rows = sorted(map(tuple, out.collect()), key=repr)
        return spark.createDataFrame(rows, out.schema), rows

    mild, rows = after("toxicity", docs)
    toxic = {
        r["doc_id"] for r in queries.op6_toxicity(spark, SMALL).filter("predicted = 1").collect()
    }
    assert mild.columns == columns and 0 < len(rows) == docs.count() - len(toxic)
    assert not toxic & {r[0] for r in rows}

    clean, lines = after("line dedup", mild)
    assert clean.columns == columns
    assert [(r[0], r[1]) for r in lines] == [x[:2] for x in plain_lines(rows)]
    assert all(r[4] == len(r[1]) for r in lines)

    single, kept = after("near duplicates", clean)
    prints = {r[0]: plain_print(r[1]) for r in lines}
    root = plain_components(
        sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3
    )
    first = {}
    for doc_id, p in prints.items():
        first[root[p]] = min(first.get(root[p], doc_id), doc_id)
    assert sorted(r[0] for r in kept) == sorted(first.values())

    mixed, taken = after("mix", single)
    times = collections.Counter(r[0] for r in taken)
    assert mixed.columns == columns and max(times.values()) <= 2
    assert set(taken) <= set(kept)

    _, tokens = after("tokens", mixed)
    assert collections.Counter(r[0] for r in tokens) == times


def test_pipeline_stages_on_odd_and_empty_rows(spark, odd, empty):
    plain = odd.select(*empty.columns)
    for docs in (plain, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            n = out.count()
            assert n == 0 or docs is plain
            if name in ("line dedup", "tokens") or (name == "toxicity" and docs is empty):
                assert n == docs.count()
            if name != "tokens":
                assert out.columns == docs.columns
    assert len(odd_rows()) == plain.count()
