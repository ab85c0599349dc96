"""Query of chat formatting over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.chat import perspectives
from rivulet.llm.common import table


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
n AS (SELECT conv_id, speaker, CASE WHEN k = 1 THEN safe ELSE safe || '.' || k END AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, safe ORDER BY speaker) AS k FROM (SELECT DISTINCT conv_id, speaker, regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM t))),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT t.conv_id, p.perspective, turn, t.speaker, t.speaker = perspective AS own, replace(text, '<|', '<||') AS text, md5(text) AS h,
    CASE WHEN t.speaker = perspective THEN '<|assistant|>' WHEN t.speaker = 'system' THEN '<|system|>'
      ELSE '<|user name=' || name || '|>' END || chr(10) AS head
  FROM t JOIN p ON p.conv_id IS NOT DISTINCT FROM t.conv_id JOIN n ON n.conv_id IS NOT DISTINCT FROM t.conv_id AND n.speaker = t.speaker),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM s),
w AS (SELECT *, row_number() OVER o - 1 AS seq, sum(length(segment)) OVER o AS stop FROM g
  WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, CAST(turn AS BIGINT) AS turn, speaker, segment,
  CAST(stop - length(segment) AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end",
  CAST(CASE WHEN own THEN stop - length(segment) + length(head) ELSE stop END AS BIGINT) AS mask_start,
  CAST(CASE WHEN own THEN stop - 1 ELSE stop END AS BIGINT) AS mask_end
FROM w
"""
