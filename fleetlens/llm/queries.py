"""The operators as named queries over the whole given tables, with SQL where SQL can say it."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    alignment,
    bpe,
    edit_fingerprint,
    line_dedup,
    merkle,
    mixing,
    quality,
    secrets,
    sharding,
    simhash,
    token_counts,
    topk,
    toxicity,
)
from fleetlens.llm.labelled import remainder

#: Scores from which a document is called toxic, or good, by the contract.
TOXIC = GOOD = 0.3
#: Tokens that a document may have before it counts as too long.
TOKEN_LIMIT = 4096

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(docs: DataFrame, held_out, score, limit: float) -> DataFrame:
    return docs.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= limit).cast("int"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", simhash.hex_digits(F.col("print")).alias("fingerprint"), "component_id"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = quality.fit_model(docs, labels, ~held_out)
    return _scored(docs, held_out, quality.score(model, "text"), GOOD)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 4) == 2
    model = toxicity.fit_model(docs, labels, ~held_out)
    return _scored(docs, held_out, toxicity.score(model, "text"), TOXIC)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.compare_with_next(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = line_dedup.remove_boilerplate(docs, min_sites=10)  # as its SQL says
    return rows.select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=8)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.scan(_table(spark, sf_dir, "documents")))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file; by default the one that op10 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(
        _table(spark, sf_dir, "documents").select("doc_id", "text"),
        tokenizer_path(),
        results=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_scores(
        _table(spark, sf_dir, "documents"),
        tokenizer_path("byte_bpe_50k.json"),
        tokenizer_path("piece_bpe_32k.model"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    manifest = merkle.build(
        merkle.with_leaves(docs, {"text": lowered}, remainder("doc_id", 3) == 0)
    )
    asked = manifest.leaves.select("group", "rank", "key", "leaf", "altered_leaf")
    proofs = merkle.prove(manifest, asked)
    subroots = manifest.groups.select("group", F.col("digest").alias("subroot"))
    top = manifest.tops.first()  # one digest
    root = F.lit(top["digest"] if top else None).cast("binary").alias("root")
    rows = proofs.join(subroots, "group").select("*", root)
    again = merkle.folded(F.coalesce("altered_leaf", "leaf"), "path")
    return rows.withColumn("again", again).select(
        F.col("key").alias("doc_id"),
        *(merkle.shown(c).alias(c) for c in ("leaf", "subroot", "root")),
        merkle.shown(merkle.proof_digest("path")).alias("proof_sha256"),
        merkle.shown("again").alias("folded_root"),
        (F.col("again") == F.col("root")).alias("verified"),
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = token_counts.prefix_tables(
        _table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")
    )
    return tables.select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
        token_counts.longest_within("prefix_table", F.lit(TOKEN_LIMIT)).alias("fit_chars"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality": op2_quality,
        "op3_fingerprints": op3_fingerprints,
        "op4_line_dedup": op4_line_dedup,
        "op5_topk": op5_topk,
        "op6_toxicity": op6_toxicity,
        "op7_mixing": op7_mixing,
        "op8_sharding": op8_sharding,
        "op9_secrets": op9_secrets,
        "op10_bpe": op10_bpe,
        "op11_alignment": op11_alignment,
        "op12_merkle": op12_merkle,
        "op13_token_counts": op13_token_counts,
    }


OP4_SQL = """
WITH l AS (
    SELECT doc_id, coalesce('=' || source, '') AS site,
           unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM documents
), b AS (
    SELECT trim(line) AS line, min((doc_id, pos)) AS place
    FROM l WHERE length(trim(line)) >= 20
    GROUP BY trim(line) HAVING count(DISTINCT site) >= 10
), k AS (
    SELECT l.doc_id, l.line, l.pos, b.line IS NULL OR b.place = (l.doc_id, l.pos) AS keep
    FROM l LEFT JOIN b ON trim(l.line) = b.line
), r AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep) AS text,
           count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_removed
    FROM k GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""

OP5_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP7_SQL = """
WITH d AS (
    SELECT doc_id, source,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':'
               || coalesce(text, '')), 1, 6) AS BIGINT) AS place
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
    FROM d GROUP BY source
), c AS (
    SELECT *, source_size * CAST(2 AS DOUBLE) AS cap FROM s
), l AS (
    SELECT *, row_number() OVER o AS place,
           sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER b, 0) AS lft,
           sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS opn
    FROM c
    WINDOW o AS (ORDER BY cap / weight, source NULLS LAST),
           b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
    SELECT place, lft, opn FROM l WHERE lft * weight <= cap * opn ORDER BY place LIMIT 1
), t AS (
    SELECT source, source_size,
           CASE WHEN l.place >= f.place THEN weight * f.lft / f.opn ELSE cap END AS target
    FROM l CROSS JOIN f
), p AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes
    FROM t
), g AS (
    SELECT source, place + 1 AS upto,
           sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS run
    FROM d GROUP BY source, place
    UNION ALL SELECT source, 0, 0 FROM s
), n AS (
    SELECT p.source, arg_min(upto, (abs(run - (target - passes * source_size)), run, upto)) AS upto
    FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source GROUP BY p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN place < upto THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d
JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN n ON d.source IS NOT DISTINCT FROM n.source
"""


_CRC_STEPS = """crc AS (
    SELECT list(list_reduce(range(8), lambda c, b:
               CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS steps
    FROM (SELECT unnest(range(256)) AS n)
)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, byte by byte, where `crc` is joined."""
    return f"""xor(list_reduce(
               list_transform(regexp_extract_all(hex(encode({text})), '..'),
                              lambda h: CAST('0x' || h AS BIGINT)),
               lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)),
               4294967295)"""


def _op8_sql(shards: int = 8) -> str:
    """Every capacity from the least thinkable up is tried; CRC-32 goes byte by byte."""
    steps, columns = [], ""
    for i in range(1, shards):
        steps.append(
            f"c{i} AS (SELECT p.cap{columns}, CASE WHEN {i} < {shards} - alone "
            f"THEN coalesce(o.cum, 0) ELSE p.at{i - 1} END AS at{i}, p.alone "
            f"FROM c{i - 1} AS p ASOF LEFT JOIN o ON p.at{i - 1} + p.cap >= o.cum)"
        )
        columns += f", p.at{i}"
    passed = " + ".join(
        f"CASE WHEN {i} < {shards} - f.alone AND o.cum > f.at{i} THEN 1 ELSE 0 END"
        for i in range(1, shards)
    )
    return f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), {_CRC_STEPS}, r AS (
    SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, md5(t) AS g,
           {_crc32("t")} AS text_crc32
    FROM d CROSS JOIN crc
), gr AS (
    SELECT g, CAST(sum(size) AS BIGINT) AS n FROM r GROUP BY g
), top AS (
    SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS k FROM gr
), lone AS (
    SELECT CAST(0 AS BIGINT) AS k, (SELECT CAST(sum(n) AS BIGINT) FROM gr) AS lft
    UNION ALL
    SELECT lone.k + 1, lft - n FROM lone JOIN top ON top.k = lone.k + 1
    WHERE lone.k < {shards - 1} AND n * ({shards} - lone.k) >= lft
), s AS (
    SELECT max(k) AS alone, min(lft) AS lft FROM lone
), o AS (
    SELECT g, n, CAST(sum(n) OVER (ORDER BY g) AS BIGINT) AS cum FROM gr
    WHERE g NOT IN (SELECT g FROM top WHERE k <= (SELECT alone FROM s))
), low AS (
    SELECT alone, lft, (SELECT max(n) FROM o) AS big,
           greatest((lft + {shards} - alone - 1) // ({shards} - alone), (SELECT max(n) FROM o)) AS least
    FROM s
), c0 AS (
    SELECT unnest(generate_series(least, least + big)) AS cap, CAST(0 AS BIGINT) AS at0, alone FROM low
), {", ".join(steps)}, f AS (
    SELECT c{shards - 1}.* FROM c{shards - 1}, low WHERE lft - at{shards - 1} <= cap ORDER BY cap LIMIT 1
), placed AS (
    SELECT g, CAST(k - 1 AS INTEGER) AS shard FROM top WHERE k <= (SELECT alone FROM s)
    UNION ALL SELECT g, CAST(f.alone + {passed} AS INTEGER) FROM o CROSS JOIN f
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard
           ORDER BY md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), r.g))) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN placed ON placed.g = r.g
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _op9_sql() -> str:
    """Matches are placed by the lengths of what lies between them, as in the operator; the
    entropy of every window is taken anew."""
    names = "|".join(map(_either_case, ("password", "passwd", "secret", "token")))
    assign = (
        rf"({names}|{_either_case('api')}_?{_either_case('key')})"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ).replace("'", "''")
    kinds = ((0, assign), (1, secrets.ACCESS), (2, secrets.HEX), (9, secrets.CANDIDATE))
    found = "\n    UNION ALL ".join(
        f"SELECT doc_id, {rank} AS rank, regexp_extract_all(t, '{p}') AS said, "
        f"string_split_regex(t, '{p}') AS between FROM d WHERE regexp_matches(t, '{p}')"
        for rank, p in kinds
    )
    allowed = " OR ".join(f"regexp_matches(s, '{p}')" for p in secrets.ALLOWED)
    said = "list_extract(['{}'], rank + 1)".format("', '".join(secrets.KINDS))
    spelled = f"string_agg({said} || ':' || a || ':' || b, ',' ORDER BY a, rank)"
    window = secrets.WINDOW
    return f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), m AS (
    {found}
), e AS (
    SELECT doc_id, rank, unnest(said) AS s, unnest(between[1:len(said)]) AS b,
           generate_subscripts(said, 1) AS n
    FROM m
), p AS (
    SELECT doc_id, rank, s,
           sum(length(b)) OVER before + sum(length(s)) OVER before - length(s) AS start
    FROM e WINDOW before AS (PARTITION BY doc_id, rank ORDER BY n)
), base AS (
    SELECT doc_id, rank, start AS a, start + length(s) AS b FROM p
    WHERE rank < 3 AND (rank > 0 OR length(regexp_extract(s, '{assign}', 2)) >= {secrets.MIN_VALUE})
), w AS (
    SELECT doc_id, start, i, substr(s, CAST(i + 1 AS INTEGER), {window}) AS w
    FROM (SELECT doc_id, start, s, unnest(generate_series(0, length(s) - {window})) AS i
          FROM p WHERE rank = 9 AND NOT ({allowed}))
), c AS (
    SELECT doc_id, start, i, list_entropy(string_split(w, '')) AS h,
           length(regexp_replace(w, '[^A-Z]', '', 'g')) AS up,
           length(regexp_replace(w, '[^a-z]', '', 'g')) AS low,
           length(regexp_replace(w, '[^0-9]', '', 'g')) AS dig,
           regexp_full_match(w, '[0-9A-Fa-f]+') AS hex
    FROM w WHERE NOT regexp_matches(w, '{secrets.ALLOWED_INSIDE}')
), h AS (
    SELECT doc_id, start, i, 3 AS rank FROM c WHERE hex AND h >= {secrets.HEX_LIMIT}
    UNION ALL
    SELECT doc_id, start, i, 4 AS rank FROM c
    WHERE dig >= 2 AND up >= 1 AND low >= 1 AND h >= {secrets.MIXED_LIMIT}
    UNION ALL
    SELECT doc_id, start, i, 5 AS rank FROM c
    WHERE NOT hex AND low + dig = {window} AND low >= 4 AND dig >= 4 AND h >= {secrets.ONE_CASE_LIMIT}
    UNION ALL
    SELECT doc_id, start, i, 6 AS rank FROM c
    WHERE NOT hex AND up + dig = {window} AND up >= 4 AND dig >= 4 AND h >= {secrets.ONE_CASE_LIMIT}
    UNION ALL
    SELECT doc_id, start, i, 7 AS rank FROM c
    WHERE up + low = {window} AND up >= 5 AND low >= 5 AND h >= {secrets.LETTERS_LIMIT}
), g AS (
    SELECT *, coalesce(i - lag(i) OVER o > {window}, TRUE) AS opens
    FROM h WINDOW o AS (PARTITION BY doc_id, start, rank ORDER BY i)
), isles AS (
    SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id, start, rank ORDER BY i) AS isle
    FROM g
), added AS (
    SELECT doc_id, rank, start + min(i) AS a, start + max(i) + {window} AS b
    FROM isles GROUP BY doc_id, start, rank, isle
), spans AS (
    SELECT * FROM base
    UNION ALL
    SELECT * FROM added AS x WHERE NOT EXISTS (
        SELECT * FROM base AS y WHERE y.doc_id = x.doc_id AND y.a <= x.a AND x.b <= y.b)
), r AS (
    SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign,
           count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
           {spelled} FILTER (WHERE rank < 3) AS base_said, {spelled} AS spans
    FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_said, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""


def _op12_sql() -> str:
    """Level by level with string_agg over runs; every path is folded with its text."""

    def field(name: str) -> str:
        said = f"CAST({name} AS VARCHAR)"
        return f"coalesce(octet_length(encode({said})) || ':' || {said}, '-')"

    def leaf(text: str) -> str:
        names = ("doc_id", "source", "lang", "n_chars", text)
        return f"sha256({' || '.join(map(field, names))})"

    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH RECURSIVE {_CRC_STEPS}, f AS (
    SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS leaf,
           CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lowered)} END AS other
    FROM documents CROSS JOIN crc
), l AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
           count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS id
    FROM f
), up AS (
    SELECT g, 0 AS lvl, rank, leaf AS digest, n FROM l
    UNION ALL
    SELECT g, lvl + 1, rank // {merkle.FAN_OUT}, sha256(string_agg(digest, '' ORDER BY rank)),
           (n + {merkle.FAN_OUT - 1}) // {merkle.FAN_OUT}
    FROM up WHERE n > 1 GROUP BY g, lvl, rank // {merkle.FAN_OUT}, n
), s AS (
    SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS rank,
           count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
    SELECT '' AS g, 0 AS lvl, rank, subroot AS digest, n FROM s
    UNION ALL
    SELECT g, lvl + 1, rank // {merkle.FAN_OUT}, sha256(string_agg(digest, '' ORDER BY rank)),
           (n + {merkle.FAN_OUT - 1}) // {merkle.FAN_OUT}
    FROM top WHERE n > 1 GROUP BY g, lvl, rank // {merkle.FAN_OUT}, n
), beside AS (
    SELECT part, g, lvl, rank,
           coalesce(string_agg(digest, '') OVER (PARTITION BY part, g, lvl, rank // {merkle.FAN_OUT}
               ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
           coalesce(string_agg(digest, '') OVER (PARTITION BY part, g, lvl, rank // {merkle.FAN_OUT}
               ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
    FROM (SELECT 1 AS part, * FROM up UNION ALL SELECT 2, * FROM top) WHERE n > 1
), w AS (
    SELECT id, g, 0 AS lvl, rank, coalesce(other, leaf) AS digest, '' AS proof FROM l
    UNION ALL
    SELECT id, w.g, w.lvl + 1, w.rank // {merkle.FAN_OUT}, sha256(lft || digest || rgt),
           proof || lft || rgt
    FROM w JOIN beside b ON part = 1 AND b.g = w.g AND b.lvl = w.lvl AND b.rank = w.rank
), v AS (
    SELECT id, 0 AS lvl, s.rank, digest, proof
    FROM (SELECT id, g, arg_max(digest, lvl) AS digest, arg_max(proof, lvl) AS proof
          FROM w GROUP BY id, g) x JOIN s ON s.g = x.g
    UNION ALL
    SELECT id, v.lvl + 1, v.rank // {merkle.FAN_OUT}, sha256(lft || digest || rgt), proof || lft || rgt
    FROM v JOIN beside b ON part = 2 AND b.lvl = v.lvl AND b.rank = v.rank
), e AS (
    SELECT id, arg_max(digest, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM v GROUP BY id
)
SELECT l.doc_id, leaf, subroot, top.digest AS root, sha256(proof) AS proof_sha256, folded_root,
       folded_root = top.digest AS verified
FROM l JOIN e ON e.id = l.id JOIN s ON s.g = l.g JOIN top ON top.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": OP4_SQL,
        "op5_topk": OP5_SQL,
        "op7_mixing": OP7_SQL,
        "op8_sharding": _op8_sql(),
        "op9_secrets": _op9_sql(),
        "op12_merkle": _op12_sql(),
    }
