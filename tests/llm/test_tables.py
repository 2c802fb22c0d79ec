"""Mixing, sharding and top-k search against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, odd_rows

from fleetlens.llm import mixing, sharding, topk

# Mixing


def plain_targets(sizes):
    """Clamp, share the excess out by weight, again until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s] * (1 + 1e-12)}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(rows, docs):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sizes = collections.defaultdict(int)
    for r, n in zip(rows, words, strict=True):
        sizes[r[3]] += n
    found = mixing.mix(docs).select("row.*", "size", "source_size", "target", "times").collect()
    assert len(found) == len(rows)
    target, taken, largest = plain_targets(sizes), collections.Counter(), collections.Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["times"] <= 2
        taken[r["source"]] += r["size"] * r["times"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    return target, taken, largest


def test_mix_comes_near(spark):
    draw = random.Random(1)
    rows = []
    for i in range(3000):
        source = draw.choice(["hot"] * 10 + [f"s{k}" for k in range(9)] + [None])
        rows.append((i, "w " * draw.randint(0, 400), None, source, None))
    docs = spark.createDataFrame(rows, DOCS)
    target, taken, largest = check_mix(rows, docs)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s]
    again = mixing.mix(docs.repartition(3)).select("row.doc_id", "times")
    first = mixing.mix(docs).select("row.doc_id", "times")
    assert sorted(again.collect()) == sorted(first.collect())
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == first.agg(F.sum("times")).first()[0]


def test_mix_odd_rows(spark, odd, empty):
    docs = odd.drop("size").withColumn("size", F.lit("clash"))
    found = mixing.mix(docs)
    assert found.count() == len(odd_rows())
    check_mix(odd_rows(), spark.createDataFrame(odd_rows(), DOCS))
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0
    nothing = spark.createDataFrame([(1, "", None, "a", 0), (2, None, None, "b", 0)], DOCS)
    assert [r["target"] for r in mixing.mix(nothing).collect()] == [0.0, 0.0]


# Sharding


def plain_capacity(sizes, shards):
    """Least capacity of any cut of the ordered sizes into contiguous shards."""
    best = {0: [0] + [math.inf] * len(sizes)}
    sums = [0, *itertools.accumulate(sizes)]
    row = best[0]
    for _ in range(shards):
        row = [
            min(max(row[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))
        ]
    return row[-1]


def check_shards(rows, docs, shards):
    found = sharding.assign_shards(docs, shards=shards).collect()
    assert len(found) == len(rows)
    by_key = collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found)
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    assert by_key == collections.Counter((i, len(d) + 1, zlib.crc32(d)) for i, d in data)
    slots, loads, places = collections.defaultdict(list), collections.Counter(), {}
    for r in found:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        place = places.setdefault((r["size"], r["text_crc32"]), r["shard"])
        assert place == r["shard"]  # equal texts stay together
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    groups = collections.Counter()
    for _, d in data:
        groups[hashlib.md5(d).hexdigest()] += len(d) + 1
    left, alone = sum(groups.values()), 0
    for _, n in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if alone < shards - 1 and n * (shards - alone) >= left:
            left, alone = left - n, alone + 1
            groups = {g: m for g, m in groups.items() if m != n or g != _}
    expected = plain_capacity([groups[g] for g in sorted(groups)], shards - alone)
    others = [n for s, n in loads.items() if s >= alone]
    assert max(others, default=0) == expected
    return loads


@pytest.mark.parametrize("trials", [48, 3])
def test_shards_are_minimal(spark, monkeypatch, trials):
    monkeypatch.setattr(sharding, "TRIALS", trials)
    draw = random.Random(trials)
    rows = [(i, "x" * draw.randint(0, 300) + str(i % 90), None, None, None) for i in range(150)]
    check_shards(rows, spark.createDataFrame(rows, DOCS), 8)


def test_group_larger_than_a_shard(spark):
    rows = [(i, "the same text in a third of all rows", None, None, None) for i in range(60)]
    rows += [(100 + i, f"other text of number {i}", None, None, None) for i in range(120)]
    loads = check_shards(rows, spark.createDataFrame(rows, DOCS), 4)
    assert loads[0] == 60 * 37


def test_shards_odd_rows(spark, odd, empty):
    check_shards(odd_rows(), odd, 8)
    check_shards(odd_rows()[:2], spark.createDataFrame(odd_rows()[:2], DOCS), 8)
    check_shards(odd_rows(), odd, 1)
    assert sharding.assign_shards(empty).count() == 0


# Top-k


def plain_top(rows, k=10):
    vectors = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((n, i, [math.floor(1024 * x) for x in v]))
    out = []
    for n, i, q in vectors:
        if i is None or i % 100:
            continue
        scores = [
            (-sum(a * b for a, b in zip(q, c, strict=False)), j is None, j or 0, j)
            for m, j, c in vectors
            if m != n
        ]
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [(1024, 8192), (2, 40)])
def test_top_k_equals_plain(spark, blocks):
    draw = random.Random(blocks[0])
    scale = [draw.choice([0.01, 0.1, 3.0]) for _ in range(20)]
    rows = [(i, [draw.gauss(0, s) for s in scale]) for i in range(600)]
    rows += [(700 + i, rows[i][1]) for i in range(0, 600, 3)]  # ties
    rows += [(100, rows[5][1]), (100, rows[100][1]), (None, rows[7][1]), (None, None)]
    rows += [(901, [float("nan")] * 20), (902, [None] * 20), (903, [float("inf")] + [0.0] * 19)]
    rows += [(904, []), (1000, [5.0, 7.0]), (905, [-1.0] * 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumns({n: F.lit("x") for n in ("row_id", "values", "score", "rank", "q", "c")})
    found = topk.top_k(
        df, lambda i: i % 100 == 0, query_block=blocks[0], candidate_block=blocks[1]
    ).collect()
    assert sorted(map(tuple, found), key=repr) == plain_top(rows)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    pick = lambda i: i % 100 == 0
    assert list(map(tuple, topk.top_k(df, pick).collect())) == [(0, 1, 1, 2 * 1024 * 1024)]
    assert topk.top_k(df.filter("vec_id = 0"), pick).count() == 0
    assert topk.top_k(df.filter("vec_id < 0"), pick).count() == 0
