"""Query of the source mixture over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import materialise, table
from rivulet.llm.mixing import WORD_COUNT, mix_sources


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # the words are counted once; later steps see narrow rows
    rows = materialise(docs.select("doc_id", "source", F.expr(WORD_COUNT).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text")), "sizes")
    return mix_sources(rows, size="size", finish=True).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "finish")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(md5(coalesce(text, '')))) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM s0),
s2 AS (SELECT *, [5, 2, 1][(rk - 1) % 3 + 1] AS weight, 2 * source_size AS stop FROM s1),
s3 AS (SELECT *, stop / CAST(weight AS DOUBLE) AS ratio,
    CAST(3 * sum(source_size) OVER () - 2 * coalesce(sum(stop) OVER (ORDER BY stop / CAST(weight AS DOUBLE), rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(2 * sum(weight) OVER (ORDER BY stop / CAST(weight AS DOUBLE), rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s2),
s4 AS (SELECT level FROM s3 WHERE level * weight <= stop ORDER BY ratio, rk LIMIT 1),
s AS (SELECT source, source_size, rk, least(CAST(stop AS DOUBLE), s4.level * weight) AS target FROM s3, s4),
q AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.rk, d.h,
    sum(d.size) OVER (PARTITION BY s.rk ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source),
e AS (SELECT doc_id, h, size, rk, CAST(cum + r * source_size AS DOUBLE) / target AS f FROM q, (SELECT unnest([0, 1]) AS r) WHERE size > 0 AND target > 0),
k AS (SELECT doc_id, count(*) AS copies FROM (SELECT doc_id, sum(size) OVER (ORDER BY f, rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM e)
  WHERE c <= (SELECT sum(source_size) * 1.5::DOUBLE FROM s) GROUP BY 1)
SELECT q.doc_id, size, source_size, target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken, source, CAST(coalesce(copies, 0) AS INTEGER) AS copies,
  CASE WHEN size > 0 AND target > 0 THEN CAST(cum AS DOUBLE) / target END AS finish
FROM q LEFT JOIN k ON k.doc_id = q.doc_id
"""
