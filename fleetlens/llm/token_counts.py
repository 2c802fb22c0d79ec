"""Token counts of every prefix of a text, by dynamic programming over its prefixes.

The vocabulary is a SentencePiece BPE model with byte fallback.  Merging goes by score, so
a row of pieces is what merging makes of its text exactly if that holds for each piece alone
and for each two neighbours: the first merge over a boundary would also be made if only the
two pieces beside it were there.  The last piece of a prefix is hence the one suffix in the
vocabulary that may stand behind the last piece of what comes before it, and

    count(prefix) = count(prefix without its last piece) + 1.

Whether two pieces may stand side by side is found once per pair, by going through the merges
that make either of them and asking whether one over the boundary would come first.  A character outside the vocabulary counts one token per byte.

No piece goes on behind its space marks with another one, so the counts of a text are those
of its words strung together.  Words repeat a lot and their counts are kept in a bounded
table.  New words are cut where no piece holds the two characters side by side; what is between
cuts repeats too, and is kept likewise.  Long texts are taken a segment at a time, long words a character at a time.

The result of a text is its prefix table: per code point, the change of the count as one
signed byte (a longer prefix can have fewer tokens).  `tokens_before` and `longest_within`
answer questions about truncation and budgets from it without the text.

Defined results: null is an empty text; an empty text has no tokens and an empty table;
repeated rows give repeated results; an empty table gives no rows; only the key and the text
are read.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from fleetlens.llm.columns import quoted

SPACE = "▁"
SEGMENT = 1 << 16  # characters of a text cut into words together
MEMO_WORDS = 300_000
MEMO_CHARS = 48  # longer words are not kept
MEMO_PAIRS = 1_000_000
_ID = 22  # bits of a piece's number in a pair
_PROBES = ("a", "  a b ", "the quick\n\nbrown fox", "<s>x</s>", "éß́ \U00012000\t\x00", SPACE + "x")


def _automaton(pieces: list[str]) -> tuple[list[dict[str, int]], list[int], list[tuple]]:
    """By state: the next by character, the one to fall back to, and the pieces that end here.

    A state is the longest end of the text read that begins a piece.  Pieces come the longest
    first, as (minus their length, number)."""
    goto, own, depth = [{}], [0], [0]
    for number, piece in enumerate(pieces[1:], 1):
        state = 0
        for c in piece:
            to = goto[state].get(c)
            if to is None:
                to = goto[state][c] = len(goto)
                goto.append({})
                own.append(0)
                depth.append(depth[state] + 1)
            state = to
        own[state] = number
    fail, ends, queue = [0] * len(goto), [()] * len(goto), [0]
    for state in queue:
        for c, to in goto[state].items():
            back = fail[state]
            while back and c not in goto[back]:
                back = fail[back]
            fail[to] = goto[back].get(c, 0) if state else 0
            here = ((-depth[to], own[to]),) if own[to] else ()
            ends[to] = here + ends[fail[to]]
            queue.append(to)
    return goto, fail, ends


class PrefixCounter:
    """Prefix tables for one model file."""

    def __init__(self, source: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=source)
        plain = [
            i
            for i in range(library.get_piece_size())
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))
        ]
        self.score = {library.id_to_piece(i): library.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        joined = {c for piece in self.score if len(piece) > 1 for c in piece}
        # Neighbours inside some piece; no merge goes over any others.
        self.joins = {piece[i : i + 2] for piece in self.score for i in range(len(piece) - 1)}
        if any(a != SPACE and b == SPACE for p in self.score for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece goes on with a space mark")
        inside = "".join(map(re.escape, sorted(joined - {SPACE})))
        # A word with its space marks; marks alone; characters that no longer piece holds.
        self.words = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]+")
        self.cut = re.compile(f"(?<=[^{SPACE}]){SPACE}")
        # Pieces by number; 0: nothing before.
        self.pieces = ["", *self.score]
        self.goto, self.fail, self.ends = _automaton(self.pieces)
        self.making: dict[int, tuple | None] = {}
        self.beside: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.memo_parts: dict[str, bytes] = {}
        for probe in _PROBES:
            if sum(np.frombuffer(self.table(probe), np.int8)) != len(library.encode(probe)):
                raise ValueError("not a BPE model with byte fallback and texts as they are")

    def merged(self, text: str, steps: list | None = None) -> list[str]:
        """The pieces of a short text: best score first, then leftmost.

        `steps` gets of each merge its score, and the text's first and last piece after it."""
        score = self.score.get
        piece, after = list(text), list(range(1, len(text) + 1))
        before = list(range(-1, len(text) - 1))
        end = len(text) - 1
        heap = [
            (-s, i, p) for i in range(len(text) - 1) if (s := score(p := text[i : i + 2])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            s, i, p = heapq.heappop(heap)
            j = after[i]
            if not piece[i] or j >= len(text) or piece[i] + piece[j] != p:
                continue
            piece[i], piece[j] = p, ""
            after[i] = k = after[j]
            if k < len(text):
                before[k] = i
            else:
                end = i
            if steps is not None:
                steps.append((-s, piece[0], piece[end]))
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < len(text):
                    joined = piece[left] + piece[right]
                    if (s := score(joined)) is not None:
                        heapq.heappush(heap, (-s, left, joined))
        return [p for p in piece if p]

    def _made(self, number: int) -> tuple[str, str, list] | None:
        """First and last character of a piece and the steps that make it, then a least
        score; None if merging does not make it."""
        if number in self.making:
            return self.making[number]
        piece, steps = self.piece(number), []
        whole = self.merged(piece, steps) == [piece]
        found = (piece[0], piece[-1], [*steps, (-math.inf, "", "")]) if whole else None
        if number < len(self.pieces):
            self.making[number] = found
        return found

    def _apart(self, before: int, last: int) -> bool:
        """Whether no merge goes over the boundary of two pieces while they are made.

        Up to such a merge each is made as if alone, and the better next step comes first."""
        a, b = self._made(before), self._made(last)
        if a is None or b is None:
            return False
        score = self.score.get
        left, steps, right, others = a[1], iter(a[2]), b[0], iter(b[2])
        step, other, over = next(steps), next(others), score(left + right)
        while True:
            mine, its = step[0], other[0]
            if over is not None and over > mine and over >= its:  # a tie goes to the left
                return False
            if mine == its == -math.inf:
                return True
            if mine >= its:
                edge, step = step[2], next(steps)
                if edge != left:
                    left, over = edge, score(edge + right)
            else:
                edge, other = other[1], next(others)
                if edge != right:
                    right, over = edge, score(left + edge)

    def _may_stand(self, before: int, last: int) -> bool:
        """Whether merging leaves two pieces apart and each of them whole."""
        if len(self.beside) >= MEMO_PAIRS:
            self.beside.clear()
        found = self._apart(before, last) if before else self._made(last) is not None
        self.beside[before << _ID | last] = found
        return found

    def piece(self, number: int) -> str:
        return self.pieces[number] if number < len(self.pieces) else chr(number - len(self.pieces))

    def word(self, word: str) -> bytes:
        """Change of the count at each character of a word, as signed bytes."""
        beside, none = self.beside.get, len(self.pieces)
        goto, fail, ends, state = self.goto, self.fail, self.ends, 0
        last, count = [0], [0]  # of the prefixes that a piece can still go back to
        out = bytearray()
        for i, c in enumerate(word):
            while (to := goto[state].get(c)) is None and state:
                state = fail[state]
            state = to or 0
            for back, number in ends[state]:
                before = last[back]
                stands = beside(before << _ID | number)
                if stands or stands is None and self._may_stand(before, number):
                    now = count[back] + 1
                    break
            else:  # a character outside the vocabulary
                number = none + ord(word[i])
                now = count[-1] + len(word[i].encode())
            out.append((now - count[-1]) & 0xFF)
            last.append(number)
            count.append(now)
            if len(last) > 4096:
                del last[: -self.longest], count[: -self.longest]
        return bytes(out)

    def _parts(self, word: str) -> list[str]:
        """A word cut between neighbours that no piece holds side by side."""
        joins, at, parts = self.joins, 0, []
        if joins.issuperset(map(add, word, word[1:])):
            return [word]
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joins:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        return parts

    @staticmethod
    def _kept(memo: dict[str, bytes], said: str, found: bytes) -> bytes:
        if len(said) <= MEMO_CHARS:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            memo[said] = found
        return found

    def _known(self, word: str) -> bytes:
        known, keep = self.memo_parts.get, self._kept
        found = [known(p) or keep(self.memo_parts, p, self.word(p)) for p in self._parts(word)]
        return keep(self.memo, word, b"".join(found))

    def table(self, text: str) -> bytes:
        """The prefix table of a text: one signed byte per code point."""
        if not text:
            return b""
        said = SPACE + text.replace(" ", SPACE)
        known, at, parts = self.memo.get, 0, []
        while at < len(said):
            cut = self.cut.search(said, at + SEGMENT) if len(said) - at > SEGMENT else None
            end = cut.start() if cut else len(said)
            words = self.words.findall(said, at, end)
            parts.append(b"".join([known(w) or self._known(w) for w in words]))
            at = end
        table = b"".join(parts)
        # The mark before the text has no character of its own.
        return bytes([(table[0] + table[1]) & 0xFF]) + table[2:]


@functools.lru_cache(maxsize=2)
def _counter(source: bytes) -> PrefixCounter:
    return PrefixCounter(source)


def prefix_tables(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, prefix_table (one signed byte per code point).

    `model` is a path on the driver; its bytes (fixed, under a MB) are broadcast."""
    with open(model, "rb") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            sizes, totals, tables = [], [], []
            for value in batch.column(1):
                said = value.as_py() or ""
                table = counter.table(said)
                sizes.append(len(said.encode()))
                totals.append(int(np.frombuffer(table, np.int8).sum(dtype=np.int64)))
                tables.append(table)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array(tables, pa.binary()),
                ],
                names=["key", "n_bytes", "n_tokens", "prefix_table"],
            )

    schema = T.StructType(
        [
            rows.schema["key"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("prefix_table", T.BinaryType()),
        ]
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def tokens_before(table: str | Column, chars: Column) -> Column:
    """Tokens of the text's first `chars` characters (at most all), from its prefix table."""

    @pandas_udf("long")
    def answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tables, places in batches:
            yield pd.Series(
                [
                    int(np.frombuffer(t, np.int8, min(max(n, 0), len(t))).sum(dtype=np.int64))
                    for t, n in zip(tables, places, strict=True)
                ],
                dtype="int64",
            )

    return answer(_column(table), chars.cast("long"))


def longest_within(table: str | Column, budget: Column) -> Column:
    """Characters of the text's longest prefix that has at most `budget` tokens."""

    @pandas_udf("long")
    def answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tables, limits in batches:
            out = []
            for t, limit in zip(tables, limits, strict=True):
                fits = np.cumsum(np.frombuffer(t, np.int8), dtype=np.int64) <= limit
                out.append(len(t) - int(np.argmax(fits[::-1])) if fits.any() else 0)
            yield pd.Series(out, dtype="int64")

    return answer(_column(table), budget.cast("long"))


def _column(table: str | Column) -> Column:
    return F.col(table) if isinstance(table, str) else table
