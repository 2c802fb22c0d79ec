"""Alignment of two tokenizers' tokens over the same bytes, by whitespace-token anchors.

A is a byte-level BPE file (JSON, ids in merge order), B a SentencePiece model that puts a space
before a text; A gets that space too.  After full tokenisation with both libraries an anchor is a byte
offset at which tokens of both end and space-marked tokens of both begin.  Anchors are
verified: the bytes of all tokens, joined, must be the text's own, so equal offsets are equal
places.  They cut a text into windows, mostly one word long.

A window with a single token of A or of B is one group, and that token is linked with all of
the other side's.  Inside the other windows A and B are walked together, all windows of a text
at once: where both end a token, a group closes; from one end to the next, of either side, lies
the overlap of one pair of tokens, a link.

How many documents hold a linked id pair is counted over the corpus, and each document is
given the counts of its pairs.  Both work on distinct pairs per document.  The counts that
meet every document are those of the frequent pairs: whole powers of two, taken from the top
as long as they hold at most `FREQUENT_PAIRS` pairs; that table is broadcast.  All other
pairs are rare by choice and meet their documents in a shuffled join, so no key is hot.

Defined results: null and empty texts, and texts whose tokens of A or B do not give back their
bytes (a U+2581 in the text, say), have no tokens: zeros and an empty string.  A repeated
row is a document of its own.  An empty table gives no rows; only the key and the text are
read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.bpe import byte_symbols
from fleetlens.llm.columns import quoted
from fleetlens.sources.checkpoints import written_table

SPACE = "▁"
# Fixed value: the words of byte-level files that name no pattern of their own.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_CHARS = 1 << 20  # characters tokenised in one call; a longer text has one of its own
FREQUENT_PAIRS = 1_000_000  # pairs with their counts that are broadcast at most
_B_BITS = 32  # of the B id in a pair
_SAID = 11  # bytes of an id's decimal digits and the mark behind them


class Document(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    pairs: np.ndarray  # distinct, ascending
    times: np.ndarray


_NONE = Document(0, 0, 0, 0, b"", np.empty(0, np.int64), np.empty(0, np.int64))


class Vocabulary:
    """Bytes of each id, their lengths, and whether they begin with a space.

    `said` has two rows an id: what a group says of it, before another token and as the last
    of its side, which `closing` follows."""

    def __init__(self, tokens: Sequence[bytes], closing: str):
        self.tokens = list(tokens)
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        said = [f"{i}{mark}" for i in range(len(self.tokens)) for mark in f",{closing}"]
        self.said = np.array(said, dtype=f"S{_SAID}")
        self.opens = np.array([t[:1] == b" " for t in tokens], dtype=bool)

    def joined(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Aligner:
    def __init__(self, bytes_json: bytes, piece_model: bytes):
        spec = json.loads(bytes_json)
        vocab, pre = spec["model"]["vocab"], spec["pre_tokenizer"]
        rules = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        made = [vocab[u + v] for u, v in rules]
        plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if not plain or spec["normalizer"] or made != sorted(made):
            raise ValueError("not a byte-level file whose ids are ranks")
        value = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(value.get, t)): i for t, i in vocab.items() if t not in special}
        # The same merges by rank, several times as quick as from the file itself.
        self.a = tiktoken.Encoding(
            "given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        names = {i: data for data, i in ranks.items()}
        self.of_a = Vocabulary([names.get(i, b"") for i in range(max(names) + 1)], "|")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.of_b = Vocabulary([self._piece_bytes(i) for i in range(self.b.get_piece_size())], ";")
        self.said = np.concatenate([self.of_a.said, self.of_b.said])

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def _walked(self, ids_a, ends_a, ids_b, ends_b) -> tuple[np.ndarray, np.ndarray]:
        """Shared ends and links of the tokens of windows, all walked together by their ends."""
        if not len(ids_a):
            return _NONE.pairs, _NONE.pairs
        sides = np.zeros(ends_a[-1] + 1, dtype=np.int8)  # at each offset, whose tokens end
        sides[ends_a] = 1
        sides[ends_b] += 2
        ends = np.flatnonzero(sides)
        sides = sides[ends]
        # The token that spans the bytes before an end has as many ends of its side before it.
        of_a, of_b = sides & 1, sides >> 1
        i, j = np.cumsum(of_a, dtype=np.int64) - of_a, np.cumsum(of_b, dtype=np.int64) - of_b
        return ends[sides == 3], ids_a[i] << _B_BITS | ids_b[j]

    def document(self, data: bytes, a: Sequence[int], b: Sequence[int]) -> Document:
        """The alignment of the tokens `a` and `b` of a text's bytes."""
        if self.of_a.joined(a) != data or self.of_b.joined(b) != data:
            return _NONE
        ids_a, ids_b = (np.fromiter(ids, dtype=np.int64, count=len(ids)) for ids in (a, b))
        ends_a, ends_b = np.cumsum(self.of_a.sizes[ids_a]), np.cumsum(self.of_b.sizes[ids_b])
        # Anchors: both end a token there, and both begin one marked by a space.
        opens = np.zeros(len(data) + 1, dtype=np.int8)
        opens[ends_a[:-1]] = self.of_a.opens[ids_a[1:]]
        opens[ends_b[:-1]] += 2 * self.of_b.opens[ids_b[1:]]
        cuts = np.append(np.flatnonzero(opens == 3), len(data))
        to_a, to_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        one_b = size_b == 1
        one_a = (size_a == 1) & ~one_b
        several = ~(one_a | one_b)
        in_a, in_b = np.repeat(several, size_a), np.repeat(several, size_b)
        shared, links = self._walked(ids_a[in_a], ends_a[in_a], ids_b[in_b], ends_b[in_b])
        packed_a = ids_a << _B_BITS
        links = np.concatenate(
            [
                packed_a[np.repeat(one_b, size_a)] | np.repeat(ids_b[to_b[one_b] - 1], size_a[one_b]),
                np.repeat(packed_a[to_a[one_a] - 1], size_b[one_a]) | ids_b[np.repeat(one_a, size_b)],
                links,
            ]
        )
        closes = np.zeros(len(data) + 1, dtype=bool)
        closes[cuts] = closes[shared] = True
        pairs, times = np.unique(links, return_counts=True)
        groups, said = self._groups(ids_a, closes[ends_a], ids_b, closes[ends_b])
        return Document(len(ids_a), len(ids_b), groups, len(links), said, pairs, times)

    def _groups(self, ids_a, last_a, ids_b, last_b) -> tuple[int, bytes]:
        """Number and text of the groups; `last_a` and `last_b` mark the last token of each."""
        to_a, to_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        # Before an A token stand the B tokens of earlier groups, before a B token the A
        # tokens of earlier groups and of its own.
        before = np.concatenate([[0], to_b[:-1]])
        size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        rows = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        rows[np.arange(len(ids_a)) + np.repeat(before, size_a)] = 2 * ids_a + last_a
        rows[np.arange(len(ids_b)) + np.repeat(to_a, size_b)] = (
            len(self.of_a.said) + 2 * ids_b + last_b
        )
        return len(to_a), self.said[rows].tobytes().translate(None, b"\0")[:-1]

    def documents(self, texts: list[str]) -> Iterator[Document]:
        """One per text, in order; texts are tokenised together up to BATCH_CHARS."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= BATCH_CHARS:
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            of_b = self.b.encode(part, num_threads=1)
            for text, b in zip(part, of_b, strict=True):
                a = self.a.encode_ordinary(" " + text)
                yield self.document(b" " + text.encode(), a, b) if text else _NONE
            at = end


@functools.lru_cache(maxsize=1)
def _aligner(bytes_json: bytes, piece_model: bytes) -> Aligner:
    return Aligner(bytes_json, piece_model)


_LINKS = T.ArrayType(
    T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.IntegerType())])
)


def align_documents(
    docs: DataFrame, bytes_json: str, piece_model: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups_sha256, links: the distinct linked pairs, an A
    id and a B id in one long, each with how often it occurs.

    The two files are paths on the driver; their bytes (a few MB, fixed) are broadcast."""
    context = docs.sparkSession.sparkContext
    with open(bytes_json, "rb") as one, open(piece_model, "rb") as other:
        sources = context.broadcast((one.read(), other.read()))
    rows = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*sources.value)
        for batch in batches:
            texts = [value.as_py() or "" for value in batch.column(1)]
            counts: list[tuple[int, ...]] = []
            digests, pairs, times = [], [], []
            for found in aligner.documents(texts):
                counts.append(found[:4])
                digests.append(hashlib.sha256(found.groups).hexdigest() if found.n_a else "")
                pairs.append(found.pairs)
                times.append(found.times)
            offsets = np.cumsum([0, *map(len, pairs)])
            links = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate(pairs), pa.int64()),
                    pa.array(np.concatenate(times).astype(np.int32), pa.int32()),
                ],
                names=["pair", "times"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), links),
                ],
                names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
            )

    schema = T.StructType(
        [
            rows.schema["key"],
            *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("links", _LINKS),
        ]
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n_docs, best: documents that hold a pair, and whether no pair of its A id is held
    by more.  `links` has one row per document and distinct pair."""
    counts = written_table(links.groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")))
    of_a = F.shiftright("pair", _B_BITS)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n_docs").alias("most"))
    return written_table(
        counts.withColumn("a", of_a)
        .join(most, "a")
        .select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    )


def _least_frequent(counts: DataFrame, bound: int) -> int:
    """The least power of two such that at most `bound` pairs have that many documents.

    Looks at one row per power of two, at most 63."""
    power = F.floor(F.log2(F.col("n_docs"))).cast("int")
    sizes = dict(counts.groupBy(power).count().collect())
    total, least = 0, max(sizes, default=0) + 1
    while least and total + sizes.get(least - 1, 0) <= bound:
        least -= 1
        total += sizes.get(least, 0)
    return 1 << least


def link_scores(
    docs: DataFrame, bytes_json: str, piece_model: str, key: str = "doc_id", text: str = "text",
    bound: int = FREQUENT_PAIRS,
) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A
    id), count_sum (counts over links), groups_sha256."""
    aligned = written_table(
        align_documents(docs, bytes_json, piece_model, key, text)
        .withColumnRenamed(key, "key")
        .withColumn("row", F.monotonically_increasing_id())
    )
    links = aligned.select("row", F.inline("links"))
    counts = pair_counts(links.select("pair"))
    least = _least_frequent(counts, bound)
    sums = [
        F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
    ]
    frequent = F.broadcast(counts.filter(F.col("n_docs") >= least))
    scored = links.join(frequent, "pair").groupBy("row").agg(*sums)
    if least > 1:
        rare = links.join(frequent.select("pair"), "pair", "left_anti")
        # Rare pairs alone are shuffled: each is held by fewer than `least` documents.
        rest = rare.join(counts.filter(F.col("n_docs") < least).hint("merge"), "pair")
        both = scored.unionByName(rest.groupBy("row").agg(*sums))
        scored = both.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("count_sum", "n_best")))
    return aligned.join(scored, "row", "left").select(
        F.col("key").alias(key),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")),
        "groups_sha256",
    )
