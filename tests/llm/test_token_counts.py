import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.conftest import odd_rows

from fleetlens.llm import queries, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    with open(MODEL, "rb") as file:
        return token_counts.PrefixCounter(file.read())


def running(table):
    out, now = [], 0
    for byte in table:
        now += byte - 256 if byte > 127 else byte
        out.append(now)
    return out


def test_every_prefix(counter, library):
    draw = random.Random(3)
    letters = "ab ethinr<>s/▁\n\té𒀀ﬁ 1290한글の日本"
    pieces = list(counter.score)
    for i in range(600):
        if i % 2:
            text = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 30)))
        else:
            text = "".join(draw.choice(pieces).replace("▁", " ") for _ in range(draw.randrange(1, 8)))
        expected = [len(library.encode(text[:n])) for n in range(1, len(text) + 1)]
        assert running(counter.table(text)) == expected, text


def test_long_texts(counter, library):
    draw = random.Random(4)
    run = "".join(draw.choice("ABCDabcd0189+/") for _ in range(200_000))
    for text in (run, " " * 5_000, "word " * 40_000, run + " x" * 70_000, "\n" * 9_000):
        assert running(counter.table(text))[-1] == len(library.encode(text))


def test_other_models_are_refused():
    with pytest.raises(Exception):
        token_counts.PrefixCounter(b"no model")


def test_odd_rows(odd, empty, library):
    rows = token_counts.prefix_tables(odd, MODEL).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], len(r["prefix_table"])) for r in rows), key=repr)
    texts = [(r[0], r[1] or "") for r in odd_rows()]
    expected = [(i, len(t.encode()), len(library.encode(t)), len(t)) for i, t in texts]
    assert got == sorted(expected, key=repr)
    assert token_counts.prefix_tables(empty, MODEL).collect() == []


def test_questions(spark, library):
    texts = ["", "one", "international understanding of words", "é𒀀 \n x" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables = token_counts.prefix_tables(docs, MODEL)
    asked = tables.crossJoin(spark.range(-1, 40).withColumnRenamed("id", "n")).select(
        "doc_id",
        "n",
        token_counts.tokens_before("prefix_table", F.col("n")).alias("tokens"),
        token_counts.longest_within("prefix_table", F.col("n")).alias("chars"),
    )
    counts = {i: [len(library.encode(t[:n])) for n in range(len(t) + 1)] for i, t in enumerate(texts)}
    for r in asked.collect():
        known, n = counts[r["doc_id"]], r["n"]
        assert r["tokens"] == known[min(max(n, 0), len(known) - 1)]
        assert r["chars"] == max((k for k, c in enumerate(known) if c <= n), default=0)


def test_query_equals_the_library(spark, library):
    rows = queries.op13_token_counts(spark, SMALL).collect()
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for doc_id, text in texts:
        n = len(library.encode(text or ""))
        expected.append((doc_id, len((text or "").encode()), n, n > 4096))
    assert sorted(tuple(r)[:4] for r in rows) == sorted(expected)
    for r in rows:
        assert r["fit_chars"] <= r["n_bytes"]
