"""From raw documents to a tokenised training mix.

STAGES names the steps in order.  Each takes (spark, docs, sf_dir) and returns a DataFrame;
all but the last keep the columns of `documents`.  `run` applies them, each to the written
result of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, line_dedup, mixing, simhash, toxicity
from fleetlens.llm.labelled import remainder
from fleetlens.llm.queries import TOXIC, tokenizer_path
from fleetlens.sources.checkpoints import written_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below the limit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_model(docs, labels, remainder("doc_id", 4) != 2)
    return docs.filter(toxicity.score(model, "text") < TOXIC)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sources."""
    cleaned = line_dedup.remove_boilerplate(docs)
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return cleaned.select(*(changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 3-word shingles, three bits at most."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it."""
    return mixing.mixed_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with token ids, and digests of them and of what they decode to."""
    return bpe.encode_documents(
        docs.select("doc_id", "text"),
        tokenizer_path(),
        results=("n_tokens", "ids_sha256", "decoded_sha256", "ids"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokens", tokenise),
]

#: Trained scores, XXH64 and merges are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
