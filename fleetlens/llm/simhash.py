"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit in
one of two segments of 32.  Each distinct fingerprint is therefore indexed under 64 keys: a
segment with one of its bits left out.  Fingerprints that share a key are compared in full.

Rows with one key are neighbours after a sort, and a task walks over them.  Within a key it
searches breadth first and never compares a fingerprint with one already reached, so a
dense group costs about its size and yields one link per member, not one per pair.  A key
with more fingerprints than a bound is not compared at once: its rows get new keys from the
other segment by the same rule, first halves of 16 and then of 8 bits.  After that at most
2,048 fingerprints can share a key, so every key is handled and nothing is dropped.

Exact copies share one fingerprint and enter the search once.

Defined results: null and empty texts and texts without words have the fingerprint zero and
are linked like others; fewer words than a shingle make one shingle; rows that repeat are
rows of one component; a null id never names a component unless all its ids are null; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from fleetlens.llm.columns import whole
from fleetlens.llm.components import components
from fleetlens.sources.checkpoints import written_table

SHINGLE = 3
SEED = 42
DISTANCE = 3
KEY_BOUND = 4096  # fingerprints of one key compared at once
_CHUNK = 1 << 15  # shingles counted at once


def fingerprint(text: str) -> int:
    """The fingerprint as an unsigned number."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = words
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK]
        hashes = map(xxhash.xxh64_intdigest, part, repeat(SEED))
        data = np.fromiter(hashes, dtype=np.uint64, count=len(part)).astype(">u8")
        bits = np.unpackbits(data.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def simhash(text: str) -> Column:
    """The fingerprint as a long with the same bits."""

    @arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = (fingerprint(text.as_py()) for text in texts)
            yield pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return prints(whole(text))


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """(key, print, free): new keys from the `width` free bits that start at bit `free`.

    The bits are cut into two halves; each key leaves one bit of one half out.  The other
    half stays free.  A key is a hash, so that equal keys may be chance; all is compared."""
    half = width // 2
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("n"))
    each = each.withColumn("side", F.expr(f"n div {half}")).withColumn(
        "bits",
        F.expr(
            f"shiftrightunsigned(print, int(free + side * {half}))"
            f" & {(1 << half) - 1}L & ~shiftleft(1L, int(n % {half}))"
        ),
    )
    return each.select(
        F.xxhash64("key", "n", "bits").alias("key"),
        "print",
        (F.col("free") + (1 - F.col("side")) * half).cast("int").alias("free"),
    )


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Unsigned: for negative numbers bitwise_count looks at the absolute value.
    return np.bitwise_count((a ^ b).astype(np.uint64)) <= DISTANCE


def _spanning(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is near within one key, one per fingerprint at most."""
    links, rest = [], prints
    while len(rest):
        wave, rest = rest[:1], rest[1:]
        while len(wave) and len(rest):
            here, wave = wave[0], wave[1:]
            hit = _near(rest, here)
            if hit.any():
                reached, rest = rest[hit], rest[~hit]
                links.append((np.full(len(reached), here), reached))
                wave = np.concatenate([wave, reached])
    return links


def _links_of_batch(keys: np.ndarray, prints: np.ndarray, bound: int):
    """(a, b) links of whole runs of equal keys, and a mask of rows in runs over the bound."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    over = np.repeat(sizes > bound, sizes)
    pairs = starts[sizes == 2]
    near = pairs[_near(prints[pairs], prints[pairs + 1])]
    links = [(prints[near], prints[near + 1])]
    for start, size in zip(starts, sizes, strict=True):
        if 2 < size <= bound:
            links.extend(_spanning(prints[start : start + size]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    return np.minimum(a, b), np.maximum(a, b), over


def _compared(bound: int):
    """Over rows sorted by key: verified links, and the rows of keys over the bound as they
    are (with a null b).  Holds one batch and at most `bound` rows of an unfinished key."""

    def out(key, a, b, free) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key, pa.int64()),
                pa.array(a, pa.int64()),
                pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64()),
                pa.array(free, pa.int32()),
            ],
            names=["key", "a", "b", "free"],
        )

    def rows_over(keys, prints, free):
        return out(keys, prints, None, free)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        passing = None  # a key over the bound whose rows are passed on
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if passing is not None:
                n = int((now[0] == passing).sum())  # rows are sorted, so these come first
                if n:
                    yield rows_over(*(x[:n] for x in now))
                now = [x[n:] for x in now]
                if not len(now[0]):
                    continue
                passing = None
            rows = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.argmax(rows[0] == rows[0][-1]))  # where the unfinished key begins
            done, kept = [x[:last] for x in rows], [x[last:] for x in rows]
            if len(done[0]):
                a, b, over = _links_of_batch(done[0], done[1], bound)
                yield out(np.zeros(len(a), np.int64), a, b, np.zeros(len(a), np.int32))
                if over.any():
                    yield rows_over(*(x[over] for x in done))
            if len(kept[0]) > bound:
                yield rows_over(*kept)
                passing, kept = kept[0][0], [x[:0] for x in kept]
        if len(kept[0]):
            a, b, _ = _links_of_batch(kept[0], kept[1], bound)
            yield out(np.zeros(len(a), np.int64), a, b, np.zeros(len(a), np.int32))

    return run


def near_links(prints: DataFrame, bound: int = KEY_BOUND) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within DISTANCE do.

    `prints` holds the distinct fingerprints in a column `print`."""
    rows = prints.select(F.lit(0).cast("long").alias("key"), "print", F.lit(0).alias("free"))
    found = None
    for width in (64, 32, 16):
        bounded = bound if width > 16 else 1 << 62  # the last level has at most 2,048
        compared = written_table(
            _variants(rows, width)
            .repartition("key")
            .sortWithinPartitions("key")
            .mapInArrow(_compared(bounded), "key long, a long, b long, free int")
        )
        links = compared.filter(F.col("b").isNotNull()).select("a", "b")
        found = links if found is None else found.unionByName(links)
        left = compared.filter(F.col("b").isNull())
        if left.isEmpty():
            break
        rows = left.select("key", F.col("a").alias("print"), "free")
    return found


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", bound: int = KEY_BOUND
) -> DataFrame:
    """key, text_hash, print (the fingerprint as a long), root (a fingerprint that stands for
    the component), component_id: the smallest key among all documents that can be reached
    over near fingerprints."""
    prints = written_table(
        docs.select(
            F.col(key).alias("key"),
            F.xxhash64(whole(text)).alias("text_hash"),
            simhash(text).alias("print"),
        )
    )
    first = written_table(prints.groupBy("print").agg(F.min("key").alias("first")))
    linked = written_table(components(near_links(first.select("print"), bound)))
    rooted = first.join(linked, F.col("print") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "print")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # One row per distinct fingerprint; a fingerprint that a third of all rows share is
    # split on the other side of the join by adaptive execution.
    names = rooted.select("print", "root").join(named, "root")
    return prints.join(names, "print").select(
        F.col("key").alias(key), "text_hash", "print", "root", "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: the least by key (nulls last), then by a hash of its text."""
    found = near_duplicates(docs.select(key, text), key, text)
    order = F.struct(F.col(key).isNull().alias("unknown"), F.col(key).alias("id"), "text_hash")
    best = (
        found.groupBy("root")
        .agg(F.min(order).alias("best"))
        .select(
            F.coalesce(F.col("best.id").cast("string"), F.lit("")).alias("__id"),
            F.col("best.unknown").alias("__unknown"),
            F.col("best.text_hash").alias("__hash"),
        )
    )
    rows = docs.select(
        F.struct("*").alias("__row"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__id"),
        F.col(key).isNull().alias("__unknown"),
        F.xxhash64(whole(text)).alias("__hash"),
    )
    keys = ["__id", "__unknown", "__hash"]
    return rows.join(best, keys, "left_semi").dropDuplicates(keys).select("__row.*")
