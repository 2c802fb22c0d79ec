"""Text quality by compression with dictionaries of good and bad text.

Two zstandard dictionaries are built, one from texts labelled good and one from bad ones.
A text is compressed block by block with either; text that is like the good ones comes out
smaller with their dictionary.  The difference of the sizes over the text's length, and a
constant that steadies short texts, is turned into a probability by logistic regression on
labelled texts that the dictionaries have not seen.

Blocks are short, so that a long text does not become its own dictionary; all blocks of a
text count.  Fitting runs in one task over a bounded sample (see `labelled.py`); scoring is
a map over all rows without a shuffle.

Defined results: null is an empty text, whose difference is 0; without labelled rows of both
kinds every score is 0.5; repeated rows get equal scores; an empty table gives no rows;
inputs other than the named columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fleetlens.llm.columns import whole
from fleetlens.llm.labelled import MAX_LABELLED, labelled_sample

BLOCK = 512  # bytes compressed at once
DICTIONARY = 1 << 16  # bytes
STEADY = 64  # bytes added to a text's length
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    base: float


def _blocks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(texts: list[str]) -> bytes:
    blocks = [b for t in texts for b in _blocks(t)]
    random.Random(1).shuffle(blocks)
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(blocks)[:DICTIONARY]


class _Sizes:
    """The size of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for data in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            self.both.append(
                zstandard.ZstdCompressor(
                    level=LEVEL,
                    dict_data=dictionary,
                    write_content_size=False,
                    write_checksum=False,
                    write_dict_id=False,
                )
            )

    def difference(self, text: str) -> float:
        """How much smaller the good dictionary makes a text, per byte."""
        blocks = _blocks(text)
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.both)
        return (bad - good) / (sum(map(len, blocks)) + STEADY)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic regression on one input, by Newton steps."""
    scale = x.std() or 1.0
    inputs, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(inputs @ w, -35, 35)))
        ridge = 1e-3 * np.eye(2)
        curve = (inputs * (p * (1 - p))[:, None]).T @ inputs + ridge
        w -= np.linalg.solve(curve, inputs.T @ (p - y) + ridge @ w)
    return float(w[0] / scale), float(w[1])


def fit(texts: list[str], labels: list[int]) -> QualityModel:
    """Every second text builds the dictionaries, the others calibrate the score."""
    pairs = list(zip(texts, labels, strict=True))
    built = [
        _dictionary([t for i, (t, y) in enumerate(pairs) if y == kind and i % 2 == 0])
        for kind in (1, 0)
    ]
    sizes, held = _Sizes(*built), pairs[1::2] or pairs
    slope, base = _logistic(
        np.array([sizes.difference(t) for t, _ in held]), np.array([y for _, y in held], float)
    )
    return QualityModel(*built, slope, base)


def _fit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([pd.DataFrame({"text": [], "label": []}), *batches])
    labels = rows["label"].astype(int).tolist()
    if 0 < sum(labels) < len(labels):
        model = fit(rows["text"].tolist(), labels)
        yield pd.DataFrame([vars(model)])


def fit_model(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    bound: int = MAX_LABELLED,
) -> QualityModel | None:
    """The model: two dictionaries of at most 64 KB and two numbers."""
    sample = labelled_sample(docs, labels, label, learn, key, text, bound)
    fitted = (
        sample.repartition(1)
        .sortWithinPartitions("order", "key")
        .select("text", "label")
        .mapInPandas(_fit_batches, "good binary, bad binary, slope double, base double")
    )
    found = fitted.collect()
    return QualityModel(**{k: bytes(v) if isinstance(v, bytearray) else v for k, v in found[0].asDict().items()}) if found else None


def score(model: QualityModel | None, text: str) -> Column:
    """The probability that a text is good."""
    if model is None:
        return F.lit(0.5)

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _Sizes(model.good, model.bad)
        for texts in batches:
            raw = np.array([sizes.difference(t) for t in texts], dtype=float)
            yield pd.Series(
                1.0 / (1.0 + np.exp(-np.clip(model.slope * raw + model.base, -35, 35)))
            )

    return scored(whole(text))
