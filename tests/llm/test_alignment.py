import hashlib
import random
import sys
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from tests.conftest import SMALL
from tests.llm.conftest import odd_rows, sentence

from fleetlens.llm import alignment, queries

BYTES, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def spans():
    """Token ids of a text with their byte ranges, by the libraries and the printed rules."""
    a = tokenizers.Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    value = {chr(x): x for x in shown}
    value |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def ranges(ids, bytes_of):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(bytes_of(i))))
            at = out[-1][2]
        return out

    def of_a(i):
        return bytes(value[c] for c in a.id_to_token(i))

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def both(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        whole = (" " + text).encode()
        if not text or b"".join(map(of_a, ids_a)) != whole or b"".join(map(of_b, ids_b)) != whole:
            return [], []
        return ranges(ids_a, of_a), ranges(ids_b, of_b)

    return both


def plain(rows, spans):
    """The contract, every pair of tokens compared."""
    holds, found = Counter(), []
    for doc_id, text in rows:
        a, b = spans(text or "")
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        holds.update(set(links))
        groups, start = [], 0
        for end in sorted({x[2] for x in a} & {y[2] for y in b}):
            groups.append(
                "|".join(",".join(str(t[0]) for t in s if start <= t[1] and t[2] <= end) for s in (a, b))
            )
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        found.append((doc_id, len(a), len(b), len(groups), links, digest))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    return sorted(
        (
            (i, n_a, n_b, n_groups, len(links), sum(holds[p] == most[p[0]] for p in links),
             sum(holds[p] for p in links), digest)
            for i, n_a, n_b, n_groups, links, digest in found
        ),
        key=repr,
    )


def rows_of(df):
    assert df.columns[1:] == ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_rows(spark, odd, empty, spans):
    rows = [(r[0], r[1] if r[0] != 3 else r[1][:3000]) for r in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(alignment.link_scores(docs, BYTES, PIECES)) == plain(rows, spans)
    assert len(rows_of(alignment.link_scores(odd, BYTES, PIECES))) == len(rows)
    assert rows_of(alignment.link_scores(empty, BYTES, PIECES)) == []


@pytest.mark.parametrize("bound", [0, 3, 40, 10**6])
def test_any_number_of_frequent_pairs(spark, spans, bound):
    draw = random.Random(bound)
    letters = "ab ethinr<>|endoftx/▁\n\té𒀀ﬁ 1290한글の日本  "
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.randrange(60)))) for i in range(40)]
    rows += [(i, sentence(i % 7, 30)) for i in range(40, 80)] + [(80, "<|endoftext|> <s> </s>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(alignment.link_scores(docs, BYTES, PIECES, bound=bound)) == plain(rows, spans)


def test_long_texts(spark):
    run = "x9Q" * 200_000
    rows = [(1, run), (2, "a " * 100_000), (3, "\n" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for row in alignment.link_scores(docs, BYTES, PIECES).collect():
        assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] > 0


def test_query_equals_the_plain_version(spark, spans):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    few = [tuple(r) for r in docs.collect() if len(r["text"] or "") < 3000]
    expected = {r[0]: r for r in plain(few, spans)}
    rows = rows_of(queries.op11_alignment(spark, SMALL))
    assert len(rows) == docs.count()
    for row in rows:
        if row[0] in expected:  # corpus counts need all documents, the rest does not
            assert (row[:5], row[7]) == (expected[row[0]][:5], expected[row[0]][7])
    whole = {r[0] for r in rows if r[1]}
    assert whole >= {i for i, t in few if t and "▁" not in t}


def test_steps_do_not_grow_with_windows():
    with open(BYTES, "rb") as one, open(PIECES, "rb") as other:
        aligner = alignment.Aligner(one.read(), other.read())
    draw = random.Random(11)

    def steps(n):
        text = " ".join("".join(draw.choices("abcdeinorst", k=9)) for _ in range(n))
        a, b = aligner.a.encode_ordinary(" " + text), aligner.b.encode(text)
        seen = []
        sys.setprofile(lambda frame, event, value: seen.append(event))
        try:
            found = aligner.document(b" " + text.encode(), a, b)
        finally:
            sys.setprofile(None)
        assert found.n_groups >= n and found.n_links == len(a) + len(b) - found.n_groups
        return len(seen)

    assert steps(5000) < 2 * steps(50)
