"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A merge list whose rules only use tokens made by earlier rules leaves every boundary
between two symbols decided by a bounded number of symbols to its right.  `lookahead`
computes that number from the list.  The encoder therefore works on a window of a word:
every token that ends at least `lookahead` symbols before the window's end is final and is
emitted, the rest stays.  Memory is bounded by the window, however long a word is.  A token
boundary that is final never has a merge across it, so the encoder may start anew there.

Words that fit one window repeat a lot and are kept in a bounded table of results, filled
by the same transducer.  Texts are cut at spaces, so a long text is never held as a list
of its words.

Decoding feeds token ids to a state machine that keeps at most one unfinished character:
bytes in, text out.  Two renderings exist: the vocabulary's own token strings separated by
spaces, as the library gives for files without a decoder, and running text, where word
ends become spaces.

Defined results: null is an empty text; an empty text has no tokens and decodes to the
empty text; special tokens standing in a text become their ids; repeated rows give repeated
results; other columns are passed through unless named like a result, which is an error.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_END = "</w>"
SEGMENT = 1 << 16  # characters of a text looked at together
MEMO_WORDS = 300_000
MEMO_BYTES = 64  # longer words are not kept
PART_BYTES = 1 << 20  # of the texts encoded before their results are handed on
_FEW = 48  # symbols up to which a plain search for the lowest rank is quicker than a heap
_PAIR = 24  # bits of an id in a pair
_NEVER = 1 << 40
_TOPS = (0xFF, 0xFFFF, sys.maxunicode)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies:
    itself where it is printable Latin-1, else the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def lookahead(rules: Iterable[tuple[str, str]], length) -> int:
    """Symbols right of a boundary that decide whether a merge removes it.

    A rule (u, v) at a boundary fires if v stands there whole when its turn comes.  That
    depends on v's own symbols and on what earlier rules do at v's right end: rules (v, w),
    which in turn look as far as w and beyond, and those that decided how v was formed,
    which look beyond v as far as v's last part did.  One pass in rule order suffices since
    each step refers to earlier rules only.  Raises ValueError if the list is not proper
    (a rule uses a token that a later rule makes, or two rules make the same token)."""
    beyond: dict[str, int] = {}  # by token: past its right end, over the rules so far
    made: set[str] = set()
    used: set[str] = set()
    most = 0
    for u, v in rules:
        token = u + v
        if token in made or token in used:
            raise ValueError(f"not a proper merge list at {u!r} {v!r}")
        made.add(token)
        used.update((u, v))
        past = beyond.get(v, 0)
        look = length(v) + past
        most = max(most, look)
        beyond[u] = max(beyond.get(u, 0), look)
        beyond[token] = past
    return most


def _ranges(wanted, top: int) -> str:
    """The inside of a character class: code points up to `top` for which `wanted` holds."""
    out, start = [], None
    for code in range(top + 2):
        hit = code <= top and wanted(chr(code))
        if hit and start is None:
            start = code
        elif not hit and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


@functools.cache
def _young(name: str) -> str:
    """Code points younger than this Python's tables to which the regex package gives the
    property, as far as the library's pattern engine gives it too."""
    wanted = regex.compile(name)
    found = [
        c
        for code in range(0x80, sys.maxunicode + 1)
        if unicodedata.category(c := chr(code)) == "Cn" and wanted.match(c)
    ]
    split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(name), "removed", invert=True)
    return "".join(c for c, _ in split.pre_tokenize_str("".join(found)))


@functools.cache
def _classes(top: int) -> dict[str, str]:
    """Letters, numbers and white space as the library's pattern engine knows them.

    White space is without the four separators that this Python's \\s adds."""
    letters, numbers = (set(_young(name)) for name in (r"\p{L}", r"\p{N}"))
    return {
        r"\p{L}": _ranges(lambda c: c.isalpha() or c in letters, top),
        r"\p{N}": _ranges(lambda c: unicodedata.category(c)[0] == "N" or c in numbers, top),
        r"\s": _ranges(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f", top),
    }


@functools.cache
def _newer_capitals() -> dict[str, str]:
    """Capitals younger than this Python's tables, with the library's small letters."""
    small = tokenizers.normalizers.Lowercase().normalize_str
    young = regex.compile(r"[\p{Lu}\p{Lt}]")
    return {
        c: small(c)
        for code in range(0x80, sys.maxunicode + 1)
        if unicodedata.category(c := chr(code)) == "Cn" and young.match(c)
    }


def _top(text: str) -> int:
    """The least of _TOPS that no character passes."""
    if text.isascii():
        return _TOPS[0]
    try:
        text.encode("latin-1")
        return _TOPS[0]
    except UnicodeEncodeError:
        return _TOPS[1] if len(text.encode("utf-16-le")) == 2 * len(text) else _TOPS[2]


class Transducer:
    """Encoder and decoder of one tokenizer file (JSON with a byte-level BPE model)."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        rules = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.lookahead = lookahead(rules, lambda t: len(t.removesuffix(self.end)) if self.end else len(t))
        self.window = max(256, 3 * self.lookahead)
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise NotImplementedError("ids are packed as little-endian 32-bit integers")
        # A pair of ids as one number: its rank; by rank: the token made.
        self.rank = {
            self.vocab[u] << _PAIR | self.vocab[v]: i for i, (u, v) in enumerate(rules)
        }
        self.made = [self.vocab[u + v] for u, v in rules]
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        named = {i: t for t, i in (self.vocab | self.special).items()}
        self.names = [named.get(i, "").encode() for i in range(max(named) + 1)]
        # The same pattern over all of Unicode, and over parts of it with quicker classes.
        self.words = {
            top: re.compile(self._word_pattern(spec["pre_tokenizer"], top)) for top in _TOPS
        }
        self.capitals = re.compile(f"[{''.join(_newer_capitals())}]")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def _word_pattern(pre: dict, top: int) -> str:
        for step in pre.get("pretokenizers", [pre]):
            if step["type"] == "Split":
                pattern = step["pattern"]["Regex"]
                for name, inside in _classes(top).items():
                    # As given these stand inside brackets only.
                    pattern = pattern.replace(name, inside)
                return pattern
        raise ValueError("the tokenizer file names no pattern of words")

    # Encoding

    def _merged(self, symbols: list[int], size: int) -> list[tuple[int, int]]:
        """(token, end position) after all merges: lowest rank first, then leftmost."""
        rank, made = self.rank.get, self.made
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        token: list[int] = list(symbols)
        gone = [False] * size
        pairs = (rank(a << _PAIR | b) for a, b in zip(symbols, symbols[1:], strict=False))
        heap = [(r, i) for i, r in enumerate(pairs) if r is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= size or rank(token[i] << _PAIR | token[j]) != r:
                continue
            token[i], gone[j] = made[r], True
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (x := rank(token[i] << _PAIR | token[k])) is not None:
                    heapq.heappush(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := rank(token[h] << _PAIR | token[i])) is not None:
                heapq.heappush(heap, (x, h))
        return [(token[i], after[i]) for i in range(size) if not gone[i]]

    def _short(self, symbols: list[int]) -> list[int]:
        """All merges of a few symbols, in place: the same order as in `_merged`."""
        rank, made = self.rank.get, self.made
        ranks = [rank(a << _PAIR | b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NEVER:
            i = ranks.index(least)
            symbols[i] = made[least]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(symbols[i] << _PAIR | symbols[i + 1], _NEVER)
            if i:
                ranks[i - 1] = rank(symbols[i - 1] << _PAIR | symbols[i], _NEVER)
        return symbols

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of one word given byte by byte, each as soon as it is final."""
        buffer: list[int] = []
        held: int | None = None  # the newest byte: it may be the word's last
        for byte in data:
            if held is not None:
                buffer.append(self.inner[held])
            held = byte
            if len(buffer) >= self.window:
                done = 0
                for token, end in self._merged(buffer, len(buffer)):
                    if end > len(buffer) - self.lookahead:
                        break
                    yield token
                    done = end
                del buffer[:done]
        if held is not None:
            buffer.append(self.last[held])
            # The word's end is in sight, so all that is left is final.
            if len(buffer) <= _FEW:
                yield from self._short(buffer)
            else:
                for token, _ in self._merged(buffer, len(buffer)):
                    yield token

    def _word(self, word: str) -> bytes:
        data = word.encode()
        ids = array("I", self.stream(data)).tobytes()
        if len(data) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def _plain(self, text: str) -> Iterator[bytes]:
        """Ids of a text without special tokens, a segment at a time."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SEGMENT:
                end = text.rfind(" ", at + 1, at + SEGMENT)
                if end < 0:
                    end = text.find(" ", at + SEGMENT)
                end = len(text) if end < 0 else end
            part = text[at:end]
            at = end
            if not part.isascii():
                # Lower-casing goes character by character: no final form of sigma.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                if _top(part) > _TOPS[0] and self.capitals.search(part):
                    part = "".join(_newer_capitals().get(c, c) for c in part)
            part = part.lower()
            words = self.words[_top(part)].findall(part)
            known = self.memo.get
            yield b"".join([known(w) or self._word(w) for w in words])

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in pieces."""
        if "<" not in text or not self.special:
            yield from self._plain(text)
            return
        for piece in self.cut.split(text):
            if piece in self.special:
                yield np.array([self.special[piece]], dtype="<u4").tobytes()
            elif piece:
                yield from self._plain(piece)

    # Decoding

    def token_text(self, pieces: Iterable[bytes]) -> Iterator[str]:
        """Token strings separated by spaces, from pieces of packed ids."""
        machine = codecs.getincrementaldecoder("utf-8")("strict")
        between = b""
        for piece in pieces:
            ids = np.frombuffer(piece, dtype="<u4").tolist()
            if ids:
                yield machine.decode(between + b" ".join(map(self.names.__getitem__, ids)))
                between = b" "
        yield machine.decode(b"", True)

    @functools.cached_property
    def _raw(self) -> dict[int, bytes]:
        value = {s: b for b, s in enumerate(byte_symbols())}
        raw = {}
        for name, i in self.vocab.items():
            inner = name.removesuffix(self.end) if self.end else name
            raw[i] = bytes(value[c] for c in inner) + (b" " if inner != name else b"")
        return raw | {i: t.encode() for t, i in self.special.items()}

    def running_text(self, pieces: Iterable[bytes]) -> Iterator[str]:
        """The text itself; bytes that form no character become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for piece in pieces:
            yield machine.decode(b"".join([self._raw[i] for i in np.frombuffer(piece, "<u4").tolist()]))
        yield machine.decode(b"", True)


@functools.lru_cache(maxsize=2)
def _transducer(source: bytes) -> Transducer:
    return Transducer(source)


RESULTS = {
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
    "ids": T.ArrayType(T.IntegerType()),
}


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about PART_BYTES of text, so that results do not pile up for a whole batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    part = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(start, end - start)


def encode_documents(
    docs: DataFrame, tokenizer: str, text: str = "text", results: tuple[str, ...] = ("n_tokens", "ids")
) -> DataFrame:
    """All columns but the text, with the named results (see RESULTS).

    `tokenizer` is a path on the driver; its bytes (a few MB, fixed) are broadcast."""
    if clash := set(results) & set(docs.columns):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    with open(tokenizer, "rb") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(source.value)
        for batch in (part for whole in batches for part in _parts(whole, len(kept))):
            found: dict[str, list] = {name: [] for name in results}
            offsets = [0]
            for value in batch.column(len(kept)):
                pieces = list(machine.encode(value.as_py() or ""))
                n_bytes = sum(map(len, pieces))
                if "n_tokens" in found:
                    found["n_tokens"].append(n_bytes // 4)
                if "ids_sha256" in found:
                    digest = hashlib.sha256()
                    for piece in pieces:
                        digest.update(piece)
                    found["ids_sha256"].append(digest.hexdigest())
                if "decoded_sha256" in found:
                    digest = hashlib.sha256()
                    for said in machine.token_text(pieces):
                        digest.update(said.encode())
                    found["decoded_sha256"].append(digest.hexdigest())
                if "ids" in found:
                    found["ids"] += pieces
                    offsets.append(offsets[-1] + n_bytes // 4)
            columns = [batch.column(i) for i in range(len(kept))]
            for name in results:
                if name == "ids":
                    ids = pa.array(np.frombuffer(b"".join(found[name]), "<i4"))
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids))
                else:
                    kind = pa.int64() if name == "n_tokens" else pa.string()
                    columns.append(pa.array(found[name], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *results])

    schema = T.StructType(
        [docs.schema[c] for c in kept] + [T.StructField(r, RESULTS[r]) for r in results]
    )
    return docs.select(*map(_quoted, kept), _quoted(text)).mapInArrow(run, schema)


def decode_documents(
    docs: DataFrame, tokenizer: str, ids: str = "ids", out: str = "text"
) -> DataFrame:
    """All columns but the ids, with the running text that they stand for."""
    with open(tokenizer, "rb") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    kept = [c for c in docs.columns if c != ids]
    if out in kept:
        raise ValueError(f"a column is named {out} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(source.value)
        for batch in batches:
            said = []
            for value in batch.column(len(kept)):
                packed = np.array(value.as_py() or [], dtype="<u4").tobytes()
                said.append("".join(machine.running_text([packed])))
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(said, pa.string())], names=[*kept, out]
            )

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, T.StringType())])
    return docs.select(*map(_quoted, kept), _quoted(ids)).mapInArrow(run, schema)


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")
