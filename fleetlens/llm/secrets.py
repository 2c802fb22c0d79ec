"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Three base kinds are found by pattern, leftmost and without overlap: assignments to names
like password, access key ids, and long lower-case hex strings.

Further spans come from candidate strings: runs of 20 and more token characters.  A window of
20 characters slides over a candidate.  Its Shannon entropy is kept by incremental counts: a
character that enters with count c in the window adds f(c) - f(c - 1) to the sum of f(c) =
c log2 c over its characters, one that leaves takes the same off, and entropy = log2(20) -
sum / 20.  The counts are five bits wide, twelve to a long, so a step is a few sums; those of
capitals, small letters, digits and hex digits are kept alike.  Each class of characters has
its own limit.  Windows that reach it are kept, and those that touch are merged.

The allow list has two parts.  Names made of letters that end in a number and digests of the
empty text are passed over as whole candidates.  Windows that hold a documented example or a
counting sequence are passed over alone, so what stands beside them is still seen.  Spans
inside a base span are passed over too.

A candidate is cut into pieces of 60 window starts, each with the 19 characters after them,
and a window's bit is set in its piece's masks; matches are numbered in blocks.  Cost grows
with the length of a text, also of one that is a single candidate.

Everything is a column expression inside the scan: no Python, no shuffle.  Positions are
code points; the text between matches comes from splitting at the same pattern.

Defined results: null is an empty text; no match gives zero counts, empty spans and the
digest of the empty string; repeated rows give repeated results; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.columns import whole

ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters and more in all
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6  # characters of an assigned value

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PIECE = 60  # window starts of a piece: bits of a mask
#: Least entropy in bits by class: hexadecimal digits; letters of both cases with digits; letters
#: of one case with digits; letters of both cases alone.
HEX_LIMIT = 3.0
MIXED_LIMIT = 3.7
ONE_CASE_LIMIT = 3.6
LETTERS_LIMIT = 3.9
#: Candidates of this form are passed over.
ALLOWED = (
    r"^[A-Za-z]{2}[A-Za-z/_=+-]*[0-9]{1,4}$",
    r"(?i)^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709"
    r"|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
)
#: Windows that hold one of these are passed over.
ALLOWED_INSIDE = (
    r"(?i)example|sample|dummy|placeholder|changeme|x{8}|0{8}"
    r"|0123456789|1234567890|abcdefghij"
)

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("entropy_hex", "entropy_mixed", "entropy_lower", "entropy_upper", "entropy_letters")
KINDS = (*BASE_KINDS, *ADDED_KINDS)
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str) -> Column:
    """Matches as an array of (said, start, end), or null where there are none.

    Ends add up block by block, so that no array grows by single matches beyond a block."""
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = "struct<said:string,start:int,end:int>"

    def place(block: Column, offset: Column) -> Column:
        def add(found: Column, pair: Column) -> Column:
            start = found["at"] + F.char_length(pair["between"])
            end = start + F.char_length(pair["said"])
            match = F.struct(pair["said"].alias("said"), start.alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.concat(found["all"], F.array(match)).alias("all"))

        start = F.struct(offset.alias("at"), F.array().cast(f"array<{one}>").alias("all"))
        return F.aggregate(block, start, add, lambda found: found["all"])

    def placed(blocks: Column) -> Column:
        sizes = F.transform(
            blocks,
            lambda b: F.aggregate(
                b, F.lit(0), lambda n, p: n + F.char_length(p["between"]) + F.char_length(p["said"])
            ),
        )
        offsets = F.aggregate(
            sizes,
            F.array(F.lit(0)),
            lambda all_, n: F.concat(all_, F.array(F.element_at(all_, -1) + n)),
        )
        return _let(
            offsets, lambda o: F.flatten(F.transform(blocks, lambda b, i: place(b, F.get(o, i))))
        )

    def in_blocks(pairs: Column) -> Column:
        # About as many blocks as there are matches in a block.
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(pairs))).cast("int"))
        starts = F.sequence(F.lit(1), F.size(pairs), size)
        return F.transform(starts, lambda n: F.slice(pairs, n, size))

    pairs = F.zip_with(
        said,
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(said)),
        lambda s, b: F.struct(s.alias("said"), b.alias("between")),
    )
    found = _let(pairs, lambda p: _let(in_blocks(p), placed))
    return F.when(text.rlike(pattern), found).otherwise(F.lit(None).cast(f"array<{one}>"))


def _spans(matches: Column, kind: str, holds: Callable[[Column], Column] | None = None) -> Column:
    """Matches that hold, as (start, rank of the kind, end)."""
    kept = F.filter(matches, lambda m: holds(m["said"])) if holds else matches
    spans = F.transform(
        kept,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")
        ),
    )
    return F.coalesce(spans, F.array().cast(_SPANS))


# Tables by code (place in _ALPHABET) and by count, as literal arrays.


def _table(values: list) -> Column:
    return F.array(*map(F.lit, values))


_PER_LONG, _BITS = 12, 5  # counts of up to 20 in a long
_CODES = range(len(_ALPHABET))
_LONGS = -(-len(_ALPHABET) // _PER_LONG)


def _sort(c: str) -> int:
    """One for each sort that the character is of, a byte apart."""
    sorts = (c.isupper(), c.islower(), c.isdigit(), c in "0123456789abcdefABCDEF")
    return sum(int(hit) << 8 * i for i, hit in enumerate(sorts))


def _masks(codes: Column) -> Column:
    """Per added kind the window starts, as bits, of a piece given as an array of codes."""
    ones = _table([1 << _BITS * (i % _PER_LONG) for i in _CODES])
    place = _table([i // _PER_LONG for i in _CODES])
    sort = _table([_sort(c) for c in _ALPHABET])
    # What a character adds when its count becomes c, and a window's bit.
    steps = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)]
    gain = _table([0.0, *(b - a for a, b in zip(steps, steps[1:], strict=False))])
    bits = _table([1 << i for i in range(PIECE)])

    def step(state: Column, i: Column) -> Column:
        enters = F.get(codes, i)
        leaves = F.when(i >= WINDOW, F.get(codes, i - WINDOW))

        def count(code: Column) -> Column:
            held = F.get(state["counts"], F.get(place, code))
            return F.call_function("div", held, F.get(ones, code)) % (1 << _BITS)

        same = F.coalesce((leaves == enters).cast("int"), F.lit(0))
        total = (
            state["sum"]
            + F.get(gain, (count(enters) - same + 1).cast("int"))
            - F.coalesce(F.get(gain, count(leaves).cast("int")), F.lit(0.0))
        )
        counts = F.transform(
            state["counts"],
            lambda held, at: held
            + F.when(F.get(place, enters) == at, F.get(ones, enters)).otherwise(0)
            - F.when(F.get(place, leaves) == at, F.get(ones, leaves)).otherwise(0),
        )
        sorts = state["sorts"] + F.get(sort, enters) - F.coalesce(F.get(sort, leaves), F.lit(0))
        # Bounds that several classes share are computed once.
        known = F.struct(
            (math.log2(WINDOW) - total / WINDOW).alias("entropy"),
            *(
                (F.call_function("div", sorts, F.lit(1 << 8 * n)) % 256).alias(name)
                for n, name in enumerate(("upper", "lower", "digit", "hex"))
            ),
        )
        hits = _let(known, _classes)
        bit = F.get(bits, i - (WINDOW - 1))
        masks = F.zip_with(
            state["masks"], hits, lambda mask, hit: mask + F.when(hit, bit).otherwise(0)
        )
        return F.struct(
            total.alias("sum"),
            counts.alias("counts"),
            sorts.alias("sorts"),
            F.when(i >= WINDOW - 1, masks).otherwise(state["masks"]).alias("masks"),
        )

    longs = "array<bigint>"
    first = F.struct(
        F.lit(0.0).alias("sum"),
        F.array_repeat(F.lit(0), _LONGS).cast(longs).alias("counts"),
        F.lit(0).cast("long").alias("sorts"),
        F.array_repeat(F.lit(0), len(ADDED_KINDS)).cast(longs).alias("masks"),
    )
    places = F.sequence(F.lit(0), F.size(codes) - 1)
    return F.aggregate(places, first, step, lambda s: s["masks"])


def _classes(w: Column) -> Column:
    """Which of the added kinds a window is, by its counts and its entropy."""
    not_hex = w["hex"] < WINDOW
    return F.array(
        (w["hex"] == WINDOW) & (w["entropy"] >= HEX_LIMIT),
        (w["digit"] >= 2) & (w["upper"] >= 1) & (w["lower"] >= 1) & (w["entropy"] >= MIXED_LIMIT),
        *(
            not_hex
            & (w[case] + w["digit"] == WINDOW)
            & (F.least(w[case], w["digit"]) >= 4)
            & (w["entropy"] >= ONE_CASE_LIMIT)
            for case in ("lower", "upper")
        ),
        (w["upper"] + w["lower"] == WINDOW)
        & (F.least(w["upper"], w["lower"]) >= 5)
        & (w["entropy"] >= LETTERS_LIMIT),
    )


def _pieces(said: Column) -> Column:
    """(text, masks) per piece of a candidate, in order."""

    def piece(parts: Column) -> Column:
        def one(part: Column, n: Column) -> Column:
            after = F.substring(F.coalesce(F.get(parts, n + 1), F.lit("")), 1, WINDOW - 1)
            return F.concat(part, after)

        def masked(text: Column) -> Column:
            codes = F.transform(
                F.split(text, "", -1), lambda c: F.instr(F.lit(_ALPHABET), c) - 1
            )
            # A split at nothing may end in an empty string, whose code is no code.
            codes = F.slice(codes, F.lit(1), F.char_length(text))
            return F.struct(text.alias("text"), _let(codes, _masks).alias("masks"))

        return F.transform(F.transform(parts, one), masked)

    return _let(F.regexp_extract_all(said, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), piece)


def _merged(starts: Column) -> Column:
    """(start, end) of touching windows that begin at ascending starts."""
    opens = F.filter(
        starts, lambda s, i: (i == 0) | (s > F.get(starts, i - 1) + WINDOW)
    )
    ends = F.filter(
        starts, lambda s, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) > s + WINDOW)
    )
    return F.zip_with(
        opens, ends, lambda a, b: F.struct(a.alias("start"), (b + WINDOW).alias("end"))
    )


def _windows(pieces: Column, kind: str) -> Column:
    """Merged spans of a kind in a candidate's pieces; the allow list is asked per window."""
    n = ADDED_KINDS.index(kind)
    bits = _table([1 << i for i in range(PIECE)])

    def starts(piece: Column, place: Column) -> Column:
        mask = F.get(piece["masks"], F.lit(n))
        hit = F.filter(
            F.sequence(F.lit(0), F.lit(PIECE - 1)),
            lambda i: (F.call_function("div", mask, F.get(bits, i)) % 2 == 1)
            & ~F.substring(piece["text"], i + 1, F.lit(WINDOW)).rlike(ALLOWED_INSIDE),
        )
        return F.when(mask != 0, F.transform(hit, lambda i: place * PIECE + i)).otherwise(
            F.array().cast("array<int>")
        )

    return _let(F.flatten(F.transform(pieces, starts)), _merged)


def _entropy_spans(candidates: Column) -> Column:
    def allowed(said: Column) -> Column:
        out = F.lit(False)
        for pattern in ALLOWED:
            out = out | said.rlike(pattern)
        return out

    def spans(match: Column) -> Column:
        def of_kinds(pieces: Column) -> Column:
            return F.concat(
                *(
                    F.transform(
                        _windows(pieces, kind),
                        lambda w: F.struct(
                            (match["start"] + w["start"]).alias("start"),
                            F.lit(KINDS.index(kind)).alias("rank"),  # noqa: B023
                            (match["start"] + w["end"]).alias("end"),
                        ),
                    )
                    for kind in ADDED_KINDS
                )
            )

        return _let(_pieces(match["said"]), of_kinds)

    found = F.transform(F.filter(candidates, lambda m: ~allowed(m["said"])), spans)
    return F.coalesce(F.flatten(found), F.array().cast(_SPANS))


def _said(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the three groups of base spans, and the `added` spans, as arrays of
    (start, rank in KINDS, end)."""
    said = whole(text)
    matched = docs.select(
        F.col(key).alias("key"),
        _spans(
            _matches(said, ASSIGN),
            "assign",
            lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_VALUE,
        ).alias("assign"),
        _spans(_matches(said, ACCESS), "access").alias("access"),
        _spans(_matches(said, HEX), "hex").alias("hex"),
        _matches(said, CANDIDATE).alias("candidates"),
    )
    with_base = matched.withColumn("base", F.concat(*BASE_KINDS))
    added = F.when(
        F.col("candidates").isNull(), F.array().cast(_SPANS)
    ).otherwise(_entropy_spans(F.col("candidates")))
    outside = F.filter(
        "added",
        lambda a: ~F.exists("base", lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"])),
    )
    return with_base.withColumn("added", added).select(
        F.col("key").alias(key), *BASE_KINDS, "base", outside.alias("added")
    )


def span_digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as one string."""
    return scanned.select(
        key,
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _said(F.concat("base", "added")).alias("spans"),
    )
