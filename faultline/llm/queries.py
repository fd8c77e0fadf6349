"""The registered queries: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import alignment, conversations, fingerprints, language, mixing, near_dedup, packing, pii, quality, secret_scan, substrings, topk, toxicity
from faultline.llm._shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"), radius=3)


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


ORACLE["op9_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
    FROM pairs
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 10
"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE["op10_substring_dedup"] = """
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), firsts AS (
    SELECT words, min(doc_id) AS first FROM windows GROUP BY words
), gone AS (
    SELECT DISTINCT doc_id, i + j AS i FROM (
        SELECT doc_id, i, unnest(range(0, 50)) AS j FROM windows JOIN firsts USING (words) WHERE first < doc_id)
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.report(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")))


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find(table(spark, sf_dir, "documents")))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damage(convs), convs)


ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
), coded AS (  -- CRC-32, a bit at a time
    SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS fault
    FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(0, CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded WHERE fault <> 0
), placed AS (
    SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
    FROM damaged
), faults AS (
    SELECT conv_id, turn, role, text, initial, i,
           CASE WHEN seen = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), FALSE) AS illegal
    FROM placed
), walk AS (  -- the cheapest, then least (cost, audit, rows) that ends with nothing, a system, a user and an assistant row
    SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': '', 'r': ''} AS v0, {'c': 1000000000, 'a': '~', 'r': ''} AS v1,
           {'c': 5, 'a': 'I', 'r': chr(10) || 'user:'} AS v2, {'c': 10, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS v3
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i, n0, n1, m2, least(n3, {'c': m2.c + 5, 'a': m2.a || 'I', 'r': m2.r || chr(10) || 'assistant:'})
    FROM (
        SELECT conv_id, i, n0, n1, n3, least(n2, {'c': b.c + 5, 'a': b.a || 'I', 'r': b.r || chr(10) || 'user:'}) AS m2
        FROM (
            SELECT conv_id, i, n0, n1, n2, n3, least(n0, n1, n3) AS b
            FROM (
                SELECT w.conv_id, f.i, {'c': v0.c + 2, 'a': v0.a || 'D', 'r': v0.r} AS n0,
                       least({'c': v1.c + 2, 'a': v1.a || 'D', 'r': v1.r},
                             {'c': v0.c + more + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END, 'a': v0.a || 'K', 'r': v0.r || own}) AS n1,
                       least({'c': v2.c + 2, 'a': v2.a || 'D', 'r': v2.r},
                             {'c': u.c + more + CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END, 'a': u.a || 'K', 'r': u.r || own},
                             {'c': u.c + more + 1, 'a': u.a || 'R', 'r': u.r || chr(10) || 'user:' || text}) AS n2,
                       least({'c': v3.c + 2, 'a': v3.a || 'D', 'r': v3.r},
                             {'c': v2.c + more + CASE WHEN initial = 'a' THEN 0 ELSE 1000000000 END, 'a': v2.a || 'K', 'r': v2.r || own},
                             {'c': v2.c + more + 1, 'a': v2.a || 'R', 'r': v2.r || chr(10) || 'assistant:' || text}) AS n3
                FROM (SELECT *, least(v0, v1, v3) AS u FROM walk) w JOIN (
                    SELECT *, chr(10) || role || ':' || text AS own,
                           CASE fault WHEN 'blank' THEN 1000000000 WHEN 'duplicate' THEN 1000000000 WHEN 'truncated' THEN 5 ELSE 0 END AS more
                    FROM faults) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)))
), ended AS (
    SELECT conv_id, least(v0, v3) AS v FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
    FROM faults GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(e.v.c AS BIGINT) AS cost, e.v.a AS audit, sha256(substr(e.v.r, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
