"""Registered queries of the training-data operators and their DuckDB statements.

Every query reads whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import (clustering, decontamination, exact_dedup, gru_lm, lexical_search, line_dedup, minhash, mixing, quality,
               suffix_dedup, token_counts, topk_search, toxicity)
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_words(table(spark, sf_dir, "documents"))
    # the splitting tree's decision: the shard of each draw of the document
    return out.withColumn("shards", F.transform("draws", lambda d: d["shard"])).drop("draws")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .select("doc_id", "contaminated", "item_ids"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))
    components = F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string")))
    return out.withColumn("centroid_sha256", F.sha2(components, 256)).drop("centroid")


OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_cp,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
), r AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size
    FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


OP6_SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(list_zip(range(len(x)), x)) AS p
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), k AS (
    SELECT doc_id, p[1] AS pos, p[2] AS line,
           translate(trim(p[2], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l
), r AS (
    SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
    SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP11_SQL = r"""
WITH d AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), b AS (
    SELECT item_id, term, count(*) AS q FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY ALL
), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(t.docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM p, t GROUP BY term),
s AS (
    SELECT b.item_id, p.doc_id,
           sum(b.q * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * n.n * t.docs) // t.len))))::BIGINT AS score
    FROM p JOIN w USING (term) JOIN b USING (term) JOIN n USING (doc_id), t
    GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""

_INTEGERS_SQL = """
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

OP12_SQL = f"""
WITH v AS ({_INTEGERS_SQL})
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, c.vec_id) AS INTEGER) AS rank,
       c.vec_id, s.score
FROM v AS q, v AS c, LATERAL (
    SELECT CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score) AS s
WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
QUALIFY rank <= 20
"""


def _clustering_sql(rounds: int) -> str:
    def assigned(centroids: str) -> str:
        return f"""
    SELECT vec_id, v, m.distance, m.c FROM (
        SELECT vec_id, v, min(ROW(CAST(list_sum(list_transform(list_zip(v, cv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), c)
                              ::STRUCT(distance BIGINT, c BIGINT)) AS m
        FROM v, {centroids} GROUP BY vec_id, v)"""

    steps = [f"""v AS (SELECT * FROM ({_INTEGERS_SQL}) WHERE len(v) = 64),
r0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS cv
       FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16))"""]
    for i in range(rounds):
        steps.append(f"a{i} AS ({assigned(f'r{i}')})")
        steps.append(f"""u{i} AS (SELECT c, list(f ORDER BY pos) AS cv FROM (
    SELECT c, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS f
    FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS pos FROM a{i}) GROUP BY c, pos) GROUP BY c)""")
        steps.append(f"r{i + 1} AS (SELECT r{i}.c, coalesce(u{i}.cv, r{i}.cv) AS cv FROM r{i} LEFT JOIN u{i} USING (c))")
    steps.append(f"last AS ({assigned(f'r{rounds}')})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(cv, ',')) AS centroid_sha256
FROM last JOIN r{rounds} USING (c)"""


OP13_SQL = _clustering_sql(3)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_mix_sources, op2_token_counts, op3_exact_dedup, op4_near_dedup, op5_quality,
        op6_line_dedup, op7_lm_scoring, op8_toxicity,
        op9_suffix_dedup, op10_decontamination,
        op11_lexical_search, op12_topk_search, op13_clustering)}


def llm_oracles() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op6_line_dedup": OP6_SQL, "op11_lexical_search": OP11_SQL,
            "op12_topk_search": OP12_SQL, "op13_clustering": OP13_SQL}
