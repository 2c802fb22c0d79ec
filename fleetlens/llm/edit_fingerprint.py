"""Document fingerprints by a randomised edit embedding.

A walk over a text's characters writes the current character and then stays or moves on by
a random bit that depends on the step and the character; the bits are shared by all texts.
Two texts a few edits apart soon fall into step again, so the number of differing places in
what is written (Hamming distance) follows the edit distance.  A fingerprint is a sample of
128 places of the written string, one byte each.  Equal texts write equal strings.

Places are sampled for any length without a limit: the k-th place for a text is the least
of a random order among all places the text can reach.  Along growing lengths that place
changes only at records of the order, which are drawn directly, so texts of nearly equal
length are sampled at nearly equal places.

The walk goes through whole texts.  Many texts walk at once, a step of all of them being a
few array operations; a text that continues another's beginning takes up its walk.

`linked_documents` finds near documents by bands of sampled bytes, and verifies whole
fingerprints.  Members of one band value are compared in groups of bounded size; a larger
set is cut into blocks, each pair of blocks being a group, so no pair is missed.

Defined results: null is an empty text, whose fingerprint is all zeros; texts under four
characters have nothing to replace; a single document is its own next; ids that repeat are
ordered by text, and null ids come last, ordered by a hash of their texts; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fleetlens.llm.columns import whole
from fleetlens.llm.components import components
from fleetlens.sources.checkpoints import written_table

SAMPLES = 128
BAND = 8  # places sampled again for a band
BANDS = 40
LIKENESS = 0.8
GROUP = 2048  # fingerprints compared at once
SEED = 7
_STEPS = 1 << 12  # random bits of a character repeat after so many steps
_CELLS = 1 << 22  # characters walked at once
_CHARS = 1 << 22  # characters of texts held at once
_ROWS = 1 << 14  # and rows, as many texts may be empty


@functools.cache
def _stays() -> np.ndarray:
    """For character class and step: steps until the walk has moved on, flattened."""
    moves = np.random.default_rng(SEED).integers(0, 2, (256, _STEPS), dtype=np.uint8)
    moves[:, 0] = 1  # some step always moves on
    twice = np.concatenate([moves, moves], axis=1)
    stays = np.zeros((256, 2 * _STEPS), dtype=np.int32)
    ahead = np.full(256, 1, dtype=np.int32)
    for step in range(2 * _STEPS - 1, -1, -1):
        ahead = np.where(twice[:, step] == 1, 1, ahead + 1)
        stays[:, step] = ahead
    return np.ascontiguousarray(stays[:, :_STEPS]).ravel()


@functools.cache
def _records() -> np.ndarray:
    """Per sample the places at which the least of a random order changes, ascending.

    If place p is the least so far, the next lesser one is p' with P(p' > q) = (p + 1) /
    (q + 1)."""
    draw = np.random.default_rng(SEED + 1)
    out = np.zeros((SAMPLES, 80))
    for i in range(1, out.shape[1]):
        out[:, i] = np.ceil((out[:, i - 1] + 1) / (1.0 - draw.random(SAMPLES)))
    return np.minimum(out, 2.0**60).astype(np.int64)


def classes(text: str) -> np.ndarray:
    """Characters as numbers from 1 to 255."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return ((codes * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(255) + 1).astype(np.uint8)


def walk(texts: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """For each text the step after which each of its characters is left."""
    ends: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    stays, at = _stays(), 0
    while at < len(order) and sizes[order[at]]:
        longest = int(sizes[order[at]])
        block = order[at : at + max(1, _CELLS // longest)]
        block = block[sizes[block] > 0]
        at += len(block)
        place = np.zeros((longest, len(block)), dtype=np.int32)
        for b, i in enumerate(block):
            place[: sizes[i], b] = texts[i]
        place *= _STEPS
        left = np.zeros_like(place)
        now = starts[block].astype(np.int32)
        # Texts are sorted by falling length, so the ones still walking come first.
        walking = len(block) - np.searchsorted(np.sort(sizes[block]), np.arange(longest), "right")
        for step, n in enumerate(walking.tolist()):
            here = now[:n]
            here += stays.take(place[step, :n] + (here & (_STEPS - 1)))
            left[step, :n] = here
        for b, (i, own) in enumerate(zip(block, np.ascontiguousarray(left.T), strict=True)):
            ends[i] = own[: sizes[i]].copy()
    return ends


def sampled(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of a fingerprint; 0 where the walk ended before the place."""
    n = len(text)
    if n == 0:
        return np.zeros(SAMPLES, dtype=np.uint8)
    records = _records()
    last = (records < 2 * n).sum(axis=1) - 1
    place = np.searchsorted(ends, records[np.arange(SAMPLES), last], "right")
    return np.where(place < n, text[np.minimum(place, n - 1)], 0).astype(np.uint8)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    coded = [classes(t) for t in texts]
    ends = walk(coded, np.zeros(len(coded), dtype=np.int32))
    return [sampled(c, e) for c, e in zip(coded, ends, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of sampled places that agree."""
    return float((a == b).mean())


# Fingerprints of documents, their edited texts and their neighbours by id

_RESULT = (
    "key long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _compared(keys: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, each with the text after it."""
    coded = [classes(t) for t in texts]
    ends = walk(coded, np.zeros(len(coded), dtype=np.int32))
    prints = [sampled(c, e) for c, e in zip(coded, ends, strict=True)]
    kept = [len(c) - len(c) // 4 for c in coded[:-1]]
    added = [coded[i + 1][: len(coded[i]) - k] for i, k in enumerate(kept)]
    began = np.array([e[k - 1] if k else 0 for e, k in zip(ends, kept, strict=False)], np.int32)
    more = walk(added, began)
    rows = []
    for i, k in enumerate(kept):
        edited = texts[i][:k] + texts[i + 1][: len(coded[i]) - k]
        edited_print = sampled(
            np.concatenate([coded[i][:k], added[i]]), np.concatenate([ends[i][:k], more[i]])
        )
        rows.append(
            (
                keys[i],
                len(coded[i]),
                hashlib.sha256(edited.encode()).hexdigest(),
                prints[i].tobytes().hex(),
                edited_print.tobytes().hex(),
                likeness(prints[i], edited_print),
                likeness(prints[i], prints[i + 1]),
            )
        )
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=[c.split()[0] for c in _RESULT.split(", ")],
    )


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, text, target, copy) in order: each document with the one after it.

    A range ends with a copy of the first document of the range after it."""
    keys: list = []
    texts: list[str] = []
    held, target, closed = 0, None, False
    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        for key, text, aim, copy in zip(*columns, strict=True):
            key, text, aim, copy = key.as_py(), text.as_py(), aim.as_py(), copy.as_py()
            if aim != target:
                if len(keys) > 1:
                    yield _compared(keys, texts)
                keys, texts, held, target, closed = [], [], 0, aim, False
            if closed:  # the next document has come already
                continue
            closed = copy
            keys.append(key)
            texts.append(text)
            held += len(text)
            if (held > _CHARS or len(keys) > _ROWS) and len(keys) > 1:
                yield _compared(keys, texts)
                keys, texts = keys[-1:], texts[-1:]
                held = len(texts[0])
    if len(keys) > 1:
        yield _compared(keys, texts)


def _range_starts(docs: DataFrame, key: str, text: str, ranges: int) -> list[tuple[int, int]]:
    """(ids are null, place) at which each range begins, ascending: values of the table.

    There are at most two per range.  A sketch of the places gives the edges; as it rounds
    large numbers, the least place within each pair of edges is then looked up."""
    found: list[tuple[int, int]] = []
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    for unknown, column in ((0, F.col(key).cast("long")), (1, F.xxhash64(whole(text)))):
        rows = docs.filter(F.col(key).isNull() if unknown else F.col(key).isNotNull())
        if unknown and rows.select(key).isEmpty():
            continue
        at = rows.select(column.alias("at"))
        sketched = at.agg(F.percentile_approx("at", shares, 50 * ranges)).first()[0]
        edges = np.unique(np.array(sketched or [], dtype=np.int64))

        @pandas_udf("long")
        def between(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for places in batches:
                yield pd.Series(np.searchsorted(edges, places.to_numpy(), "right"))  # noqa: B023

        firsts = at.groupBy(between("at").alias("n")).agg(F.min("at").alias("first")).collect()
        found += sorted((unknown, r["first"]) for r in firsts)
    return found


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the last quarter is
    replaced by the beginning of the document next by key, with their likeness.

    Texts are shuffled once, into ranges of the key.  The first document of a range is
    copied to the end of the range before it, so every document meets its next one without
    a global order in one task."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = _range_starts(docs, key, text, n)
    known = np.array([v for unknown, v in starts if not unknown], dtype=np.int64)
    other = np.array([v for unknown, v in starts if unknown], dtype=np.int64)

    @pandas_udf("array<int>")
    def targets(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for unknown, at in batches:
            at = at.to_numpy(dtype=np.int64)
            own = np.where(
                unknown.to_numpy(dtype=bool),
                len(known) + np.searchsorted(other, at, "right") - 1,
                np.searchsorted(known, at, "right") - 1,
            )
            first = np.concatenate([known, other])[own] == at
            before = (own - 1) % max(1, len(starts))
            yield pd.Series(
                [[o, b] if f else [o] for o, b, f in zip(own, before, first, strict=True)]
            )

    unknown = F.col(key).isNull()
    at = F.coalesce(F.col(key).cast("long"), F.xxhash64(whole(text)))
    placed = docs.select(
        F.col(key).cast("long").alias("key"),
        whole(text).alias("text"),
        unknown.alias("unknown"),
        at.alias("at"),
        F.posexplode(targets(unknown, at)).alias("copy", "target"),
    )
    return (
        placed.repartitionById(max(1, len(starts)), F.col("target"))
        .sortWithinPartitions("target", "copy", "unknown", "at", "text")
        .select("key", "text", "target", (F.col("copy") > 0).alias("copy"))
        .mapInArrow(_along, _RESULT)
        .withColumnRenamed("key", key)
    )


# Near documents by bands


def _spanning(rows: pd.DataFrame) -> pd.DataFrame:
    prints = np.stack([np.frombuffer(p, dtype=np.uint8) for p in rows["print"]])
    name = rows["name"].to_numpy()
    out, rest = [], np.arange(len(name))
    while len(rest):
        wave, rest = [rest[0]], rest[1:]
        while wave and len(rest):
            here = wave.pop()
            hit = (prints[rest] == prints[here]).mean(axis=1) >= LIKENESS
            out += [(name[here], name[i]) for i in rest[hit]]
            wave += list(rest[hit])
            rest = rest[~hit]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def linked_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP
) -> DataFrame:
    """key and component_id: the smallest key among documents whose fingerprints agree in
    LIKENESS of their places, directly or over others, as far as bands bring them together
    (two that agree in 0.8 of the places miss all 40 bands of 8 places once in 1,500)."""
    draw = np.random.default_rng(SEED + 2)
    places = [sorted(draw.choice(SAMPLES, BAND, replace=False)) for _ in range(BANDS)]

    @pandas_udf("binary")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([p.tobytes() for p in fingerprints(list(texts))])

    rows = written_table(
        docs.select(F.col(key).alias("key"), printed(whole(text)).alias("print")).withColumn(
            "name", F.xxhash64("print")
        )
    )
    distinct = rows.groupBy("name").agg(F.min("print").alias("print"), F.min("key").alias("first"))
    bands = distinct.select(
        "name",
        F.explode(
            F.array(
                *(
                    F.xxhash64(F.lit(b), *(F.substring("print", int(p) + 1, 1) for p in own))
                    for b, own in enumerate(places)
                )
            )
        ).alias("band"),
    )
    sizes = bands.groupBy("band").agg(F.count("name").alias("n")).filter(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / group).cast("int")
    paired = (
        bands.join(sizes, "band")
        .join(distinct.select("name", "print"), "name")
        .withColumn("own", F.pmod("name", blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    )
    links = (
        paired.groupBy("band", F.least("own", "other"), F.greatest("own", "other"))
        .applyInPandas(_spanning, "a long, b long")
        .distinct()
    )
    linked = written_table(components(links))
    rooted = distinct.select("name", "first").join(
        linked, F.col("name") == F.col("node"), "left"
    ).withColumn("root", F.coalesce("root", "name"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    names = rooted.join(named, "root").select("name", "component_id")
    return rows.join(names, "name").select(F.col("key").alias(key), "component_id")
