"""Query of the conversation prefix trie over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.common import table
from rivulet.llm.prefix_trie import prefix_trie


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# crc32 bit by bit; the polynomial is a fixed value
OP13_SQL = r"""
WITH t AS MATERIALIZED (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda a, b:
    list_reduce(range(8), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, 0 AS own, place, digest, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, digest, words FROM c JOIN t ON t.conv_id = c.conv_id AND place > h),
d AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth FROM s),
o AS MATERIALIZED (SELECT conv_id, depth, words, string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS last FROM o GROUP BY 1),
n AS MATERIALIZED (SELECT node, min(o.conv_id) AS conv_id, any_value(depth) AS depth, any_value(words) AS words, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(o.conv_id AS VARCHAR), ',' ORDER BY o.conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM o JOIN l USING (conv_id) GROUP BY 1),
e AS (SELECT n.*, p.node AS parent FROM n LEFT JOIN o p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
k AS (SELECT parent, count(*) AS n_children FROM e GROUP BY 1),
b AS (SELECT a.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM n JOIN o a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN k ON k.parent = n.node GROUP BY 1)
SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, e.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, e.ends_sha256
FROM e JOIN b ON b.node = e.node LEFT JOIN k ON k.parent = e.node LEFT JOIN n q ON q.node = e.parent
"""
