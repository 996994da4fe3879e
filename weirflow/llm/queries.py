"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import ann, byte_bpe, fingerprint, html_extract, mixing, near_dedup, sharding, token_counts, toxicity
from weirflow.llm.url_filter import UrlRule, judge_urls
from weirflow.plans.runtime import checkpoint_dir, table

URL_RULES = (
    UrlRule("allow", "com"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24, store)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern())


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filters, op2_source_mixing, op3_html_extraction, op4_fingerprints, op5_toxicity, op6_minhash_near_dedup, op7_sharding, op8_token_counts, op9_nearest_neighbours, op10_byte_bpe)}


_URL_SQL = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null ' || md5(coalesce(text, ''))) || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(k - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM s),
l AS (
  SELECT *, most / w AS lim,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY most / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT *, max(CASE WHEN level <= lim THEN level END) OVER () AS final_level FROM l),
g AS (SELECT source, source_size, n, CASE WHEN coalesce(lim <= final_level, true) THEN most ELSE final_level * w END AS target FROM t),
h AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS base FROM g),
b AS (SELECT *, target - base * source_size AS rest FROM h),
p AS (
  SELECT d.doc_id, d.size, d.source, b.source_size, b.target, b.base, b.rest,
         (u / (1 - u)) / (least(1 - 1e-12, greatest(1e-12, rest / b.source_size)) / (1 - least(1 - 1e-12, greatest(1e-12, rest / b.source_size)))
                          * sqrt(greatest(d.size, 1)::DOUBLE / (b.source_size::DOUBLE / b.n))) AS q
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle FROM p)
SELECT doc_id, size, source_size, target, ((base + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _URL_SQL, "op2_source_mixing": _MIX_SQL}
