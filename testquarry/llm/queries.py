"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .bpe import digests, encode_decode
from .common import unsigned_crc
from .embedding_dedup import near_vectors
from .langid import identify, train
from .line_dedup import dedup_lines
from .minhash_dedup import near_duplicates
from .mixing import mix_documents
from .mixing import oracle as mixing_oracle
from .packed_tokens import packed_tokens
from .quality_rules import quality_rules
from .sharding import shard_documents


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_docs(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_docs", "host_failed", "host_rate", "host_low", "host_bad"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = F.coalesce(unsigned_crc(F.col("doc_id")) % 3 == 1, F.lit(False))
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(_docs(spark, sf_dir)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = F.coalesce(unsigned_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    model = train(docs, ~held_out)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_docs(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_docs(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"), shortest=1)
    return clean.select("doc_id", "n_lines", "n_removed", unsigned_crc(F.coalesce("text", F.lit(""))).alias("clean_crc32"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("clean_chars"))


def op10_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tokens(_docs(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_byte_bpe, op4_language_id, op5_sharding, op6_mixing, op7_embedding_dedup, op8_minhash_dedup, op9_line_dedup, op10_packed_tokens)}


RULES_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), r AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM d) LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS host_docs, count(*) FILTER (base_failed) AS host_failed FROM b GROUP BY host),
p AS (SELECT sum(host_failed)::DOUBLE / sum(host_docs) AS mean, greatest(0, sum(host_failed::DOUBLE * host_failed / host_docs) / sum(host_docs) - (sum(host_failed)::DOUBLE / sum(host_docs)) ** 2) AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least(1e6, greatest(1, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS weight FROM p),
u AS (SELECT h.*, mean, weight, (host_failed + mean * weight) / (host_docs + weight) AS rate FROM h, q),
v AS (SELECT *, rate - 2 * sqrt(rate * (1 - rate) / (host_docs + weight + 1)) AS low FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND low <= greatest(0.2, 2 * mean / (1 + mean)) AS kept,
       b.host, host_docs, host_failed, round(rate, 9) AS host_rate, round(low, 9) AS host_low, low > greatest(0.2, 2 * mean / (1 + mean)) AS host_bad
FROM b JOIN v ON b.host IS NOT DISTINCT FROM v.host
"""

_REACH_SQL = """
reach(a, b) AS (SELECT src, dst FROM e UNION SELECT reach.a, e.dst FROM reach JOIN e ON e.src = reach.b)
"""

VECTORS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
e AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= 0.95),
{_REACH_SQL}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT src AS vec_id, count(*) AS n FROM e GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1) USING (vec_id)
"""

SHINGLES_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS MATERIALIZED (SELECT x AS src, y AS dst FROM l UNION ALL SELECT y, x FROM l),
{_REACH_SQL}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": RULES_SQL, "op6_mixing": mixing_oracle(), "op7_embedding_dedup": VECTORS_SQL, "op8_minhash_dedup": SHINGLES_SQL}
