import random

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, odd_rows

from fleetlens.llm import simhash
from fleetlens.llm.components import components


def plain_print(text):
    """The contract, word for word."""
    import re

    import xxhash

    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    n = 3 if len(words) >= 3 else len(words)
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)
    ]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    expected = [(r[0], plain_print(r[1])) for r in odd_rows()]
    unsigned = [(r["doc_id"], r["print"] % (1 << 64)) for r in rows]
    assert sorted(unsigned, key=repr) == sorted(expected, key=repr)
    prints = sorted({p for _, p in expected})
    root = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for doc_id, p in expected:
        if doc_id is not None:
            first[root[p]] = min(first.get(root[p], doc_id), doc_id)
    for r in rows:
        assert r["component_id"] == first.get(root[r["print"] % (1 << 64)])


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    found = simhash.near_duplicates(odd).select("root").distinct().count()
    assert len(rows) == found
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [-5, 1, 3, 4, 7, 8, 9] or (
        {r["doc_id"] for r in rows} >= {-5, 1, 3, 4, 7, 8, 9}
    )


@pytest.mark.parametrize("bound", [4096, 8, 2])
def test_links_equal_all_pairs(spark, bound):
    """Dense groups, with keys over the bound sent through the further levels."""
    draw = random.Random(bound)
    prints = {draw.getrandbits(64) for _ in range(200)}
    for _ in range(4):
        centre = draw.getrandbits(64)
        for _ in range(60):
            p = centre
            for bit in draw.sample(range(64), draw.randint(0, 5)):
                p ^= 1 << bit
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    links = simhash.near_links(df, bound).collect()
    for r in links:
        assert ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 3
    found = plain_components(signed, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 3)
    by_links = plain_components_of(signed, [(r["a"], r["b"]) for r in links])
    assert found == by_links


def plain_components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1200)]
    links += [(5, 5), (2, 1), (2000, 1999)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["root"] for r in components(df).collect()}
    expected = {i: 1 for i in range(1, 201)} | {i: 1000 for i in range(1000, 1200)}
    assert found == expected | {1999: 1999, 2000: 1999}
    assert components(df.filter(F.lit(False))).count() == 0


def test_one_document(spark):
    df = spark.createDataFrame([(3, "A b  C\td", None, None, None)], DOCS)
    row = simhash.near_duplicates(df).first()
    assert row["component_id"] == 3 and row["print"] % (1 << 64) == plain_print("a b c d")
