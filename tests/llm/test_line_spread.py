"""Which lines the pipeline's stage takes for boilerplate when few sites hold them."""

from tests.llm.conftest import DOCS, sentence

import corpus_pipeline
from fleetlens.llm import line_dedup

LONG = "a planted line of more than eight words that stands on some sites"
SHORT = "Home | About | Contact us"


def test_few_sites_and_a_hot_one(spark):
    """Six sites, one with a third of the rows; texts come back as they were otherwise."""
    rows, planted = [], {}
    for i in range(60):
        site = "hot" if i % 3 == 0 else f"s{i % 5}"
        lines = [f"{sentence(i, 12)} own {i}"]
        if site == "hot":
            lines += ["a long line that only the hot site repeats on each of its pages"]
        if site in ("hot", "s1", "s2"):
            lines += [LONG, "Short on three sites only"]
        lines += [SHORT, "tiny"]
        planted[i] = site
        rows.append((i, "\n".join(lines), None, site, None))
    docs = spark.createDataFrame(rows, DOCS)
    out = corpus_pipeline.drop_boilerplate(spark, docs, "").collect()
    texts = {r["doc_id"]: r["text"].split("\n") for r in out}
    holding = lambda line: sorted(i for i in texts if line in texts[i])
    before = lambda line: sorted(r[0] for r in rows if line in r[1].split("\n"))
    assert holding(LONG) == before(LONG)[:1] and len(before(LONG)) > 3
    assert holding(SHORT) == [0]
    for line in ("Short on three sites only", "tiny"):
        assert holding(line) == before(line)
    hot = "a long line that only the hot site repeats on each of its pages"
    assert holding(hot) == before(hot) == [i for i in planted if planted[i] == "hot"]
    assert all(any(x.endswith(f"own {i}") for x in texts[i]) for i in texts)
    uniform = line_dedup.remove_boilerplate(docs, min_sites=10)
    assert uniform.filter("n_removed > 0").count() == 0
