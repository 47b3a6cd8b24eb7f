"""Call archives derived from the given tables: one SQL text each, the same for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CALLS = """
SELECT event_id AS id,
  '/rec/s' || CAST(user_id % 4 AS STRING) || '/' || CAST(event_id AS STRING) || '.wav' AS path,
  'REC_' || CAST(event_id AS STRING) || '_user' || CAST(user_id AS STRING) || '.wav' AS filename,
  CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 7 = 0 THEN ''
       ELSE 'contact_' || CAST(user_id AS STRING) END AS contact_hint,
  CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 13 = 0 THEN '95588'
       ELSE CAST(13800000000 + user_id AS STRING) END AS phone,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE ts END AS call_time,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE value * 20 END AS duration_sec,
  CAST(floor(value * 1000) AS BIGINT) AS size_bytes,
  CASE event_type WHEN 'purchase' THEN 'analyzed' WHEN 'view' THEN 'transcribed'
       WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'error' ELSE 'normalized' END AS status,
  CASE WHEN event_id % 23 > 3 THEN '/wav/' || CAST(event_id AS STRING) || '.wav' END AS wav_path,
  CASE WHEN event_type = 'purchase' THEN 'sum ' || CAST(user_id % 50 AS STRING) END AS summary,
  CASE WHEN event_id % 17 = 1 THEN event_id - 1 END AS dup_of,
  CASE WHEN event_id % 17 = 1 THEN CASE WHEN event_id % 3 = 0 THEN '手动指定' ELSE '自动判重' END END AS dup_reason,
  user_id % 4 AS source_id,
  CASE WHEN event_type = 'purchase' THEN
    '{"summary":"s' || CAST(event_id AS STRING) || '","events":["' || event_type || ' ' || CAST(user_id AS STRING)
    || '","  "],"topics":["t' || CAST(user_id % 12 AS STRING) || '","' || event_type || '"]}' END AS analysis
FROM events
"""
SEGMENTS = """
SELECT conv_id * 1000 + turn AS id, conv_id AS call_id, CAST(turn AS INT) AS idx,
  CASE role WHEN 'user' THEN 'me' WHEN 'assistant' THEN 'other' ELSE 'unknown' END AS who,
  CASE WHEN role = 'assistant' AND turn % 3 <> 2 THEN conv_id % 10 END AS contact_id,
  CAST(turn * 5000 AS BIGINT) AS start_ms,
  CAST(turn * 5000 AS BIGINT) + least(CAST(length(text) AS BIGINT) * 20, 45000) AS end_ms,
  text AS text_zh
FROM conversations
"""
DOC_CALLS = """
SELECT doc_id AS id, 'doc_' || CAST(n_chars AS STRING) || '.txt' AS filename,
  lang AS contact_hint, CAST(NULL AS STRING) AS phone, n_chars AS size_bytes, CAST(n_chars AS DOUBLE) / 16 AS duration_sec,
  CAST(floor(n_chars / 300) AS BIGINT) AS minute_key,
  CASE WHEN doc_id % 9 = 0 THEN '/backup/' ELSE '/orig/' END || source || '/' || CAST(doc_id AS STRING) AS path,
  CASE doc_id % 3 WHEN 0 THEN 'analyzed' WHEN 1 THEN 'pending' ELSE 'transcribed' END AS status,
  text AS fulltext_zh
FROM documents
"""
VOICES = """
SELECT vec_id AS id, CAST(floor(vec_id / 5) AS BIGINT) AS call_id, CAST(vec_id % 2 AS STRING) AS spk_local,
  CAST(label AS BIGINT) AS contact_id, vec_id * 3000 AS start_ms,
  CASE WHEN vec_id % 2 = 0 THEN 'me' ELSE 'other' END AS who, embedding
FROM embeddings
"""
CONTACTS = """
SELECT DISTINCT user_id % 10 AS id, 'contact_' || CAST(user_id % 10 AS STRING) AS name,
  CASE WHEN user_id % 10 = 7 THEN '95588' ELSE CAST(13800000000 + user_id % 5 AS STRING) END AS phone,
  CASE WHEN user_id % 10 = 7 THEN 'org' WHEN user_id % 10 IN (8, 9) THEN 'seat' END AS kind,
  CASE WHEN user_id % 10 IN (8, 9) THEN 7 END AS parent_id, (user_id % 10) * 3 AS n_calls
FROM events
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above over a folder of tables."""
    head, table = re.match(r"(?s)(.*)FROM (\w+)\s*$", sql.strip()).groups()
    head = head.replace("{", "{{").replace("}", "}}")
    return spark.sql(head + "FROM {table}", table=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def calls(spark, sf_dir) -> DataFrame:
    return frame(spark, sf_dir, CALLS)


def segments(spark, sf_dir) -> DataFrame:
    return frame(spark, sf_dir, SEGMENTS)


def doc_calls(spark, sf_dir) -> DataFrame:
    return frame(spark, sf_dir, DOC_CALLS)


def voices(spark, sf_dir) -> DataFrame:
    return frame(spark, sf_dir, VOICES)


def contacts(spark, sf_dir) -> DataFrame:
    return frame(spark, sf_dir, CONTACTS)


def with_tables(**more: str) -> str:
    """A WITH clause for DuckDB that names the derived tables."""
    named = {"calls": CALLS, "segments": SEGMENTS, "doc_calls": DOC_CALLS, "voices": VOICES, "contacts": CONTACTS} | more
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in named.items())
