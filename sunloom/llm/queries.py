"""One query per training-data operator, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm import chat, decontam, exact_dedup, html_text, langid, lm, mixing, quality, sharding, simhash
from sunloom.llm.common import table

#: Bytes of a shard where a query shows splits on small tables.
SMALL_LIMIT = 192 * 1024


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op1_mixing`` SQL can express: sizes, and every document's source's size and target."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_languages(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select("doc_id", "shard", "shard_depth", "n_bytes", "oversized")


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_sharding`` with shards of 192 KiB, which splits small tables too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, SMALL_LIMIT).select("doc_id", "shard", "shard_depth", "n_bytes", "oversized")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_chat_format,
        op3_lm_score,
        op4_language,
        op5_html_text,
        op6_exact_dedup,
        op7_simhash,
        op8_sharding,
        op9_quality,
        op10_decontamination,
        mix_targets,
        sharding_small_limit,
    )
}

#: A source is at its limit if, with all sources of a smaller size by weight at theirs, its share of the rest is above it.
TARGETS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(source_size) OVER w, 0) AS size_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, (total - 3 * size_before) * weight > 3 * source_size * (weights - weight_before) AS full_up FROM o
), f AS (
  SELECT source, source_size, CASE WHEN full_up THEN 3.0 * source_size ELSE weight * CAST(total - 3 * coalesce(sum(source_size) FILTER (full_up) OVER (), 0) AS DOUBLE)
    / (weights - coalesce(sum(weight) FILTER (full_up) OVER (), 0)) END AS target FROM c
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(CAST(target AS DOUBLE), 3) AS target
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""

CHAT_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), grown AS (
  SELECT conv_id,
    row_number() OVER w AS n,
    string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '') OVER w AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), whole AS (
  SELECT conv_id, n, prefix, n = max(n) OVER (PARTITION BY conv_id) AS last FROM grown
), first AS (
  SELECT min(conv_id) AS conv_id, n, prefix, count(*) AS n_copies FROM whole WHERE last GROUP BY n, prefix
)
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, n_copies, prefix AS rendered FROM first
WHERE NOT EXISTS (SELECT 1 FROM whole p WHERE NOT p.last AND p.n = first.n AND p.prefix = first.prefix)
"""

DEDUP_SQL = r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
  min(doc_id) OVER (PARTITION BY norm) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept,
  sha256(norm) AS text_sha256
FROM plain
"""


def sharding_sql(limit: int = sharding.PRODUCTION_LIMIT, bits: int = sharding.BITS, table_name: str = "documents") -> str:
    """Every document's least depth at which its bucket fits, from the sums of all prefixes."""
    return f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM {table_name}
), nodes AS (
  SELECT doc_id, h, n_bytes, d, h >> ({bits} - d) AS prefix FROM rows, range(0, {bits} + 1) AS r(d)
), sums AS (
  SELECT d, prefix, sum(n_bytes) AS total FROM nodes GROUP BY d, prefix
), depths AS (
  SELECT doc_id, h, n_bytes, min(d) AS depth FROM nodes JOIN sums USING (d, prefix) WHERE total <= {limit} GROUP BY doc_id, h, n_bytes
)
SELECT doc_id,
  CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), {bits}, '0'), 1, CAST(depth AS INTEGER)) END AS shard,
  CAST(depth AS INTEGER) AS shard_depth, n_bytes, false AS oversized
FROM depths
"""


ORACLE_SQL = {"mix_targets": TARGETS_SQL, "op2_chat_format": CHAT_SQL, "op6_exact_dedup": DEDUP_SQL, "op8_sharding": sharding_sql(), "sharding_small_limit": sharding_sql(SMALL_LIMIT)}
