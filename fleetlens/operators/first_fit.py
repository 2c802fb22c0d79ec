"""First-fit matching of two bounded lists of rows, as Arrow-batched functions.

Spark ships these functions by value, so workers need no copy of the package.
"""

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tolerance, relative to the larger magnitude but at least to FLOOR.
TOLERANCE = 0.02
FLOOR = 1.0
# A width that no two close values up to FLOOR exceed, with room for rounding; scaled by
# the magnitude it also bounds the distance of larger close values.
LINEAR_BIN = 0.0205

MATCHES = T.ArrayType(
    T.StructType(
        [T.StructField("truth_row", T.LongType()), T.StructField("generated_row", T.LongType())]
    )
)

PACK_ROWS = 2_000  # rows of one number whose values travel as one row
FAN_BITS = 4  # the tree of free numbers has branches of 16
LISTED = 100_000  # leaves up to which it is kept as lists, which are quicker where they fit a cache

#: Values of rows in order of their numbers: those that others ask for (asks is false) come
#: before those that ask.
PACKED = T.StructType(
    [
        T.StructField("block_no", T.LongType()),
        T.StructField("asks", T.BooleanType()),
        T.StructField("first_no", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("packed", T.BinaryType()),
    ]
)
#: A pack of asking rows: how many were served, and the values of the others.
SERVED = T.StructType([*PACKED.fields, T.StructField("matched", T.LongType())])

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def close_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    limit = np.maximum(np.maximum(np.abs(a), np.abs(b)), FLOOR) * TOLERANCE
    return ~(np.abs(a - b) > limit)


def close_ranges(values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per asked number, where the ascending values close to it begin and end.

    Finite values close to a number lie side by side around it.  Both ends are known but for
    rounding; what lies within that is halved, for all numbers at once."""

    def close(places: np.ndarray) -> np.ndarray:
        return close_matrix(values[np.minimum(places, len(values) - 1)], asked)

    size = np.abs(asked)
    slack = np.maximum(size, FLOOR) * 1e-9
    with np.errstate(over="ignore"):
        outer = np.maximum(size / (1 - TOLERANCE), size + FLOOR * TOLERANCE)
    inner = np.minimum(size * (1 - TOLERANCE), size - FLOOR * TOLERANCE)
    least, most = np.where(asked < 0, (-outer, -inner), (inner, outer))
    low = np.searchsorted(values, least - slack, "left")
    begin = np.searchsorted(values, least + slack, "right")
    while (open_ := low < begin).any():
        half = (low + begin) // 2
        hit = close(half)
        begin = np.where(open_ & hit, half, begin)
        low = np.where(open_ & ~hit, half + 1, low)
    end = np.searchsorted(values, most - slack, "left")
    high = np.searchsorted(values, most + slack, "right")
    while (open_ := end < high).any():
        half = (end + high) // 2
        hit = close(half)
        end = np.where(open_ & hit, half + 1, end)
        high = np.where(open_ & ~hit, half, high)
    return begin, end


class FreeNumbers:
    """Finite numbers of which each can be taken once, in n log n.

    A tree over the distinct values in order holds the least free position of each stretch of
    values; positions of equal values queue up behind their leaf."""

    def __init__(self, values: np.ndarray):
        self.free = n = len(values)
        self.none = n
        kind = np.int32 if n < 2**31 else np.int64
        order = np.argsort(values, kind="stable").astype(kind)
        ordered = values[order]
        new = np.ones(n, dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(new).astype(kind)
        self.values = ordered[starts]
        leaf = np.empty(n, dtype=kind)
        leaf[order] = np.cumsum(new, dtype=kind) - 1
        # Plain integers are read from a view several times as fast as from an array.
        self.order, self.leaf = memoryview(order), memoryview(leaf)
        self.next = memoryview(starts + 1)
        self.end = memoryview(np.append(starts[1:], kind(n)).astype(kind))
        level = order[starts].tolist()
        fan, few, code = 1 << FAN_BITS, len(level) <= LISTED, np.dtype(kind).char
        self.levels = [level if few else array(code, level)]
        while len(level) > fan:
            level = [min(level[i : i + fan]) for i in range(0, len(level), fan)]
            self.levels.append(level if few else array(code, level))

    def take(self, asked: np.ndarray) -> list[int]:
        """Per asked number, in turn, the first free position close to it, which it takes, or
        -1."""
        taken = [-1] * len(asked)
        if not self.free:
            return taken
        none, order, leaf, next_, end = self.none, self.order, self.leaf, self.next, self.end
        levels, leaves = self.levels, self.levels[0]
        steps = list(zip(levels, levels[1:], strict=False))
        bits, fan = FAN_BITS, 1 << FAN_BITS
        begins, ends = close_ranges(self.values, asked)
        some = np.flatnonzero(begins < ends)
        for i, left, right in zip(
            some.tolist(), begins[some].tolist(), ends[some].tolist(), strict=True
        ):
            least = none
            for level in levels:
                low, high = (left + fan - 1) >> bits, right >> bits
                if low >= high:
                    if left < right and (found := min(level[left:right])) < least:
                        least = found
                    break
                cut = low << bits
                if left < cut and (found := min(level[left:cut])) < least:
                    least = found
                cut = high << bits
                if cut < right and (found := min(level[cut:right])) < least:
                    least = found
                left, right = low, high
            if least == none:
                continue
            taken[i] = least
            self.free -= 1
            at = leaf[least]
            place = next_[at]
            if place < end[at]:
                leaves[at] = order[place]
                next_[at] = place + 1
            else:
                leaves[at] = none
            for below, level in steps:
                at >>= bits
                if level[at] != least:
                    break
                level[at] = min(below[at << bits : (at << bits) + fan])
        return taken


def first_fit_of_one(truth: np.ndarray, generated: np.ndarray) -> list[tuple[int, int]]:
    """Positions matched, for finite numbers, in n log n."""
    return [(i, j) for i, j in enumerate(FreeNumbers(generated).take(truth)) if j >= 0]


def first_fit(truth: np.ndarray, generated: np.ndarray) -> list[tuple[int, int]]:
    """Positions matched, for 2-d arrays of numbers with one row per result row."""
    if truth.shape[1] == 1 and len(truth) and len(generated):
        if np.isfinite(truth).all() and np.isfinite(generated).all():
            return first_fit_of_one(truth[:, 0], generated[:, 0])
    order = np.argsort(generated[:, 0], kind="stable")
    sorted_first = generated[order, 0]
    margin = np.maximum(np.abs(truth[:, 0]), FLOOR) * LINEAR_BIN
    low = np.searchsorted(sorted_first, truth[:, 0] - margin, "left")
    high = np.searchsorted(sorted_first, truth[:, 0] + margin, "right")
    free = np.ones(len(generated), dtype=bool)
    matches = []
    for i in range(len(truth)):
        near = order[low[i] : high[i]]
        near = near[free[near]]
        near = near[close_matrix(generated[near], truth[i]).all(axis=1)]
        if len(near):
            j = int(near.min())
            free[j] = False
            matches.append((i, j))
    return matches


def _rows_of(values: np.ndarray, width: int) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(-1, width)


def pack_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACKED, of rows (block_no, asks, row_no, value) in that order."""
    for batch in batches:
        block, asks, number, value = (
            c.to_numpy(zero_copy_only=False) for c in batch.columns
        )
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
        cuts = np.union1d(cuts, np.arange(0, len(block), PACK_ROWS))
        values = [part.tobytes() for part in np.split(value, cuts[1:])] if len(block) else []
        sizes = np.diff(np.append(cuts, len(block)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block[cuts], pa.int64()),
                pa.array(asks[cuts], pa.bool_()),
                pa.array(number[cuts], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(values, pa.binary()),
            ],
            names=PACKED.names,
        )


def serve_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SERVED, of PACKED rows by block_no, asks and first_no.

    Of a block a task holds only the values that are asked for; those that ask pass by."""
    current, held, numbers = None, [], None
    for batch in batches:
        out = []
        for block, asks, first, _, packed in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            if block != current:
                current, held, numbers = block, [], None
            values = np.frombuffer(packed, dtype=float)
            if not asks:
                held.append(values)
                continue
            if numbers is None:
                numbers, held = FreeNumbers(np.concatenate([np.empty(0), *held])), []
            left = values[np.array(numbers.take(values)) < 0]
            out.append((block, True, first, len(left), left.tobytes(), len(values) - len(left)))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        columns = zip(*out, strict=True) if out else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
            names=SERVED.names,
        )


@F.pandas_udf(T.LongType())
def matched_count(truth: pd.Series, generated: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series(
        [
            len(first_fit(_rows_of(t, w), _rows_of(g, w)))
            for t, g, w in zip(truth, generated, width)
        ],
        dtype="int64",
    )


@F.pandas_udf(MATCHES)
def matched_rows(
    truth_no: pd.Series,
    truth: pd.Series,
    generated_no: pd.Series,
    generated: pd.Series,
    width: pd.Series,
) -> pd.Series:
    out = []
    for tn, t, gn, g, w in zip(truth_no, truth, generated_no, generated, width):
        found = first_fit(_rows_of(t, w), _rows_of(g, w))
        out.append([{"truth_row": tn[i], "generated_row": gn[j]} for i, j in found])
    return pd.Series(out)
