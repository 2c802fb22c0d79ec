import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL, bag, spark_bag
from tests.llm.conftest import DOCS, odd_rows

from fleetlens.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def tree(digests):
    """Levels from the leaves to the one that is left."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def way(levels, rank):
    for level in levels[:-1]:
        start = rank - rank % 8
        run = level[start : start + 8]
        yield run[: rank - start], run[rank - start + 1 :]
        rank //= 8


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of_lang = {}
    for lang in langs:
        mine = [(r, leaf_of(r, r[1])) for r in rows if r[2] == lang]
        mine.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        of_lang[lang] = mine, tree([leaf for _, leaf in mine])
    top = tree([of_lang[lang][1][-1][0] for lang in langs])
    root, out = top[-1][0], []
    for place, lang in enumerate(langs):
        mine, levels = of_lang[lang]
        for rank, (row, leaf) in enumerate(mine):
            steps = [*way(levels, rank), *way(top, place)]
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            now = leaf_of(row, text)
            for left, right in steps:
                now = sha("".join([*left, now, *right]))
            proof = sha("".join("".join(left + right) for left, right in steps))
            out.append((row[0], leaf, levels[-1][0], root, proof, now, now == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def through_query(spark, docs, folder):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    df = queries.op12_merkle(spark, str(folder))
    assert df.columns == COLUMNS
    return spark_bag(df)


def test_odd_rows(spark, odd, empty, tmp_path):
    got = through_query(spark, odd, tmp_path / "odd")
    assert got == bag(COLUMNS, plain([tuple(r)[:5] for r in odd_rows()]))
    assert through_query(spark, empty, tmp_path / "empty") == []


@pytest.mark.parametrize("n, langs", [(1, 1), (8, 1), (9, 1), (65, 2), (700, 3), (90, 30)])
def test_any_shape(spark, n, langs, tmp_path):
    draw = random.Random(n)
    rows = []
    for i in range(n):
        lang = draw.choice([None, *(f"l{k}" for k in range(1, langs))])
        rows.append((draw.choice([i, i, None, 5]), draw.choice(["A b", "c", "", None]), lang, "s", i % 3))
    rows += [(77, "Same Row", "l1" if langs > 1 else None, None, 1)] * (n // 3)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert through_query(spark, docs, tmp_path) == bag(COLUMNS, plain(rows))


def test_equal_parts_have_one_record(spark):
    rows = [(1, "same", "en", "s", 1)] * 4096
    manifest = merkle.build(merkle.with_leaves(spark.createDataFrame(rows, DOCS)))
    assert manifest.store.count() == 4  # 8, 64, 512 and 4096 equal leaves
    assert manifest.leaves.agg(F.countDistinct("rank")).first()[0] == 4096


def test_requests_of_some_leaves(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "s", i) for i in range(200)]
    manifest = merkle.build(merkle.with_leaves(spark.createDataFrame(rows, DOCS)))
    asked = manifest.leaves.filter("key in (0, 7, 150)").select("group", "rank", "key", "leaf")
    asked = asked.unionByName(asked.filter("key = 7"))
    found = merkle.prove(manifest, asked).select("key", merkle.folded("leaf", "path").alias("root"))
    root = manifest.tops.first()["digest"]
    assert sorted((r["key"], r["root"] == root) for r in found.collect()) == [
        (0, True), (7, True), (7, True), (150, True)
    ]


def test_query_equals_sql_and_plain(spark, duck):
    got = spark_bag(queries.op12_merkle(spark, SMALL))
    said = duck.execute(queries.oracle_sql()["op12_merkle"])
    assert got == bag([d[0] for d in said.description], said.fetchall())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*DOCS.names).collect()]
    assert got == bag(COLUMNS, plain(rows))
