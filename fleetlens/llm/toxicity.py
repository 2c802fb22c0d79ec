"""Toxicity by logistic regression over hashed word n-grams and skip-grams, fitted with
FTRL-proximal.

A text's features are its distinct words, pairs of neighbours and pairs with one word
between them, hashed to a fixed number of coordinates.  FTRL-proximal gives each coordinate
a rate of its own and sets weights with little evidence to exactly zero, so the model is a
short list of weights, small enough to send to every task.  Fitting runs in one task over a
bounded sample (see `labelled.py`) in a fixed order, so it can be repeated; scoring is a
map over all rows without a shuffle.

Defined results: null is an empty text, and a text without words gets the score of the
bias alone; without labelled rows of both kinds nothing is known to be toxic and every score
is 0; repeated rows get equal scores; an empty table gives no rows; inputs other than the named columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from fleetlens.llm.columns import whole
from fleetlens.llm.labelled import MAX_LABELLED, labelled_sample

BITS = 20
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 14.0, 0.1
_WORDS = re.compile(r"\w+")
_MEMO = 300_000
_BIAS = 1 << BITS
_ODD = np.uint64(0x9E3779B97F4A7C15)  # any large odd number


class _Hashes(dict):
    """Word hashes, kept for the words of a task up to a bound; a task clears them at its end,
    since workers live on."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def features(text: str) -> np.ndarray:
    """Coordinates of a text's words, neighbours and skip-grams, repeats included."""
    words = _WORDS.findall(text.lower())
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    shift = np.uint64(64 - BITS)
    parts = [(h * _ODD) >> shift]
    for gap in (1, 2):
        a, b = h[:-gap], h[gap:]
        parts.append(((a * np.uint64(2 * gap + 1) ^ (b >> np.uint64(gap))) * _ODD) >> shift)
    return np.concatenate(parts).astype(np.int32)


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def coordinates(text: str) -> np.ndarray:
    """The distinct coordinates of a text and the bias, four bytes each."""
    return np.append(np.unique(features(text)), np.int32(_BIAS))


def fit(texts: Iterable[str], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with weights other than zero, the last of all being the bias."""
    return _fit_rows(list(map(coordinates, texts)), labels)


def _fit_rows(rows: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    z, n = np.zeros(_BIAS + 1), np.zeros(_BIAS + 1)
    l1 = np.full(_BIAS + 1, L1)
    l1[_BIAS] = 0.0

    def weights(i):
        shrunk = z[i] - np.sign(z[i]) * l1[i]
        return np.where(
            np.abs(z[i]) <= l1[i], 0.0, -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        )

    for _ in range(EPOCHS):
        for i, y in zip(rows, labels, strict=True):
            w = weights(i)
            g = _sigmoid(w.sum()) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    seen = np.flatnonzero(z)  # the others have no weight
    w = weights(seen)
    return seen[w != 0], w[w != 0]


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are taken one at a time; of each only its coordinates stay, all in one block that
    the process gives back whole."""
    found, ends, labels = array("i"), [], []
    for batch in batches:
        for text in batch.column(0):
            found.frombytes(coordinates(text.as_py()).tobytes())
            ends.append(len(found))
        labels += batch.column(1).to_pylist()
    _HASHES.clear()
    if 0 < sum(labels) < len(labels):
        at, weight = _fit_rows(np.split(np.frombuffer(found, np.int32), ends[:-1]), labels)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(weight, pa.float64())], names=["at", "weight"]
        )


def fit_model(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    bound: int = MAX_LABELLED,
) -> list[tuple[int, float]]:
    """The model: (coordinate, weight) pairs, at most 2^BITS + 1 and in practice a few
    thousand."""
    sample = labelled_sample(docs, labels, label, learn, key, text, bound)
    fitted = (
        sample.repartition(1)
        .sortWithinPartitions("order", "key")
        .select("text", "label")
        .mapInArrow(_fit_batches, "at long, weight double")
    )
    return [(r["at"], r["weight"]) for r in fitted.collect()]


def score(model: list[tuple[int, float]], text: str) -> Column:
    """The probability that a text is toxic."""
    if not model:
        return F.lit(0.0)
    table = np.zeros(_BIAS + 1)
    for at, weight in model:
        table[at] = weight
    at = np.flatnonzero(table)
    weight = table[at]

    @arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        full = np.zeros(_BIAS + 1)
        full[at] = weight
        for texts in batches:
            sums = []
            for t in texts:
                found = features(t.as_py())
                found = np.unique(found[full[found] != 0.0])
                sums.append(full[found].sum() + full[_BIAS])
            yield pa.array(_sigmoid(np.array(sums, dtype=float)), pa.float64())
        _HASHES.clear()

    return scored(whole(text))
