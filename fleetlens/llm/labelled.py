"""A bounded sample of labelled texts to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.columns import whole
from fleetlens.sources.checkpoints import written_table

MAX_LABELLED = 16_000


def remainder(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gives null."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    bound: int = MAX_LABELLED,
) -> DataFrame:
    """(key, text, label, order): at most `bound` labelled rows of those that may be learnt.

    The sample takes the ids with the smallest hashes.  Only ids and labels are compared
    with the bound; the texts come by a join with at most `bound` ids, which is the proof
    of the size that is broadcast.  Labels other than 0 and 1 and null ids are left out; an
    id labelled twice counts as 1 if any label does; of several texts with one id the first
    in text order is taken."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learn)
    chosen = written_table(
        known.groupBy(F.col(key).alias("key"))
        .agg(F.max(label).cast("int").alias("label"))
        .withColumn("order", F.xxhash64(F.col("key").cast("string")))
        .orderBy("order", "key")
        .limit(bound)
    )
    texts = docs.select(F.col(key).alias("key"), whole(text).alias("text"))
    return (
        texts.join(F.broadcast(chosen), "key")
        .groupBy("key", "label", "order")
        .agg(F.min("text").alias("text"))
    )
