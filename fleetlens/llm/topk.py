"""Exact top-k by inner product: columnar branch-and-bound over blocks.

Vectors become integers and are kept in vertical layout, one array per dimension.  For a
query, products are summed a few dimensions at a time over all candidates of a block.
After each step the norms of the dimensions still to come bound what a candidate can gain
or lose (Cauchy-Schwarz); candidates whose best case lies below the k-th worst case are
dropped and the rest is compacted.  Survivors of the last step have exact scores.

Queries and candidates are cut into blocks of bounded size and every pair of blocks is a
group of its own, so neither side is broadcast or gathered.  Each group returns at most k
rows per query, and a limit per query merges them.

Defined results: an empty vector scores 0; vectors that are null or hold null, NaN or infinite components take
no part; a shorter vector counts as zero in the dimensions it lacks; ties go to the smaller
id and then null ids; a null id is never a query; rows that repeat are candidates of their
own and only the query's own row is left out; scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.sources.checkpoints import written_table

SCALE = 1024
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
STEP = 8  # dimensions summed between two prunings
_LAST_ID = np.iinfo(np.int64).max  # stands for a null id, after all others
_FOUND = "query_row long, query_id long, vec_id long, known boolean, row_id long, score long"


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(row_id, vec_id, values) of the vectors that take part, fixed in a written table."""
    odd = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf"))
    )
    return written_table(
        df.filter(F.col(vector).isNotNull() & ~odd).select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(key).cast("long").alias("vec_id"),
            F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias(
                "values"
            ),
        )
    )


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(values), width), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _rest(squares: np.ndarray, starts: Iterator[int]) -> np.ndarray:
    """Norms over the dimensions from each start on, rounded up."""
    return np.stack([np.sqrt(squares[s:].sum(axis=0)) * (1 + 1e-9) + 1e-6 for s in starts])


def best_of_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """At most k best candidates of a block for each query of a block."""
    width = max(1, *map(len, queries["values"]), *map(len, candidates["c_values"]))
    columns = _matrix(candidates["c_values"], width).T
    asked = _matrix(queries["values"], width)
    # Dimensions that carry most of the mass come first.
    order = np.argsort(-np.square(columns.astype(float)).sum(axis=1), kind="stable")
    columns, asked = np.ascontiguousarray(columns[order]), asked[:, order]
    starts = range(STEP, width + STEP, STEP)
    rest = _rest(np.square(columns.astype(float)), starts)
    rows = candidates["c_row"].to_numpy(dtype=np.int64)
    known = candidates["known"].to_numpy(dtype=bool)
    ids = candidates["c_id"].to_numpy(dtype=np.int64)
    out = []
    for q, own, name in zip(asked, queries["row_id"], queries["vec_id"], strict=True):
        q_rest = _rest(np.square(q.astype(float))[:, None], starts)[:, 0]
        alive = np.flatnonzero(rows != own)
        score = np.zeros(len(alive), dtype=np.int64)
        for i, start in enumerate(range(0, width, STEP)):
            for d in range(start, min(start + STEP, width)):
                score = score + columns[d][alive] * q[d]
            slack = rest[i][alive] * q_rest[i]
            if len(alive) > k:
                worst = score - slack
                floor = np.partition(worst, len(worst) - k)[len(worst) - k]
                # A float may be off by some ulps of the score.
                keep = score + slack >= floor - 1 - abs(floor) * 1e-12
                alive, score = alive[keep], score[keep]
        first = np.lexsort((ids[alive], ~known[alive], -score))[:k]
        chosen = alive[first]
        out.append(
            pd.DataFrame(
                {
                    "query_row": own,
                    "query_id": name,
                    "vec_id": ids[chosen],
                    "known": known[chosen],
                    "row_id": rows[chosen],
                    "score": score[first],
                }
            )
        )
    return pd.concat(out, ignore_index=True)


def _paired(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if len(queries) and len(candidates):
            return best_of_block(queries, candidates, k)
        return pd.DataFrame(columns=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _block(row: str, n: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(n)).cast("int")


def top_k(
    df: DataFrame,
    is_query: Callable[[Column], Column],
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each query row."""
    vectors = whole_vectors(df, key, vector)
    asked = vectors.filter(F.coalesce(is_query(F.col("vec_id")), F.lit(False)))
    n_candidates = max(1, -(-vectors.count() // candidate_block))
    n_queries = max(1, -(-asked.count() // query_block))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(
        "*", _block("row_id", n_queries).alias("q"), everywhere(n_candidates).alias("c")
    )
    # Both sides come from one table.  New names give the right side columns of its own,
    # without which Spark may prune those that share an identity with the left side's.
    right = vectors.select(
        F.col("row_id").alias("c_row"),
        F.coalesce("vec_id", F.lit(_LAST_ID)).alias("c_id"),
        F.col("vec_id").isNotNull().alias("known"),
        F.col("values").alias("c_values"),
        everywhere(n_queries).alias("q"),
        _block("row_id", n_candidates).alias("c"),
    )
    found = (
        left.groupBy("q", "c")
        .cogroup(right.groupBy("q", "c"))
        .applyInPandas(_paired(k), _FOUND)
    )
    order = W.partitionBy("query_row").orderBy(
        F.desc("score"), F.desc("known"), "vec_id", "row_id"
    )
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(
        "query_id", "rank", F.when(F.col("known"), F.col("vec_id")).alias("vec_id"), "score"
    )
