"""Query of the URL filter over ``pages``.

Labels come from the table ``labels``: the document number that ends a page's
path says which of its rows describe the page (bad: low quality or toxic).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import lookup, materialise, table
from rivulet.llm.url_filter import filter_urls, url_keys

NUMBER = r"try_cast(regexp_extract(path, '/([0-9]{1,18})([.][A-Za-z]+)?/?$', 1) AS BIGINT)"


def page_labels(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """(_key, n_labelled, n_bad) of pages (_key, path); pages of one key and number are counted before they meet their labels."""
    numbered = keys.select("_key", F.expr(NUMBER).alias("doc_id")).where("doc_id IS NOT NULL").groupBy("_key", "doc_id").agg(F.count("*").alias("pages"))
    numbered = materialise(numbered, "numbered")
    bad = labels.selectExpr("doc_id", "quality = 0 OR toxic = 1 AS bad").where("bad IS NOT NULL")
    bad = bad.groupBy("doc_id").agg(F.count("*").alias("labels"), F.count_if("bad").alias("bads"))
    # paths of all hosts may end in one number
    bad = materialise(bad.join(numbered.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id"), "numbered-labels")
    found = lookup(numbered, bad, "doc_id", numbered.count())
    return found.groupBy("_key").agg(F.sum(F.col("pages") * F.col("labels")).alias("n_labelled"), F.sum(F.col("pages") * F.col("bads")).alias("n_bad"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    counts = materialise(page_labels(url_keys(pages, ()), table(spark, sf_dir, "labels")), "label-counts")
    return filter_urls(pages, counts).select("page_id", "host", "path", "rule", "verdict", "template")


_HEAD = r"""
WITH p0 AS MATERIALIZED (
  SELECT page_id, regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^?#]*', 0) AS rest FROM pages),
p1 AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/]*', 0) AS h, coalesce(rest, '') AS rest FROM p0),
p2 AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(h) + 1) AS path FROM p1),
p3 AS (SELECT page_id, host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM p2),
p AS (SELECT page_id, host, path,
    CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
    array_to_string(segs, '/') AS lex,
    try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})([.][A-Za-z]+)?/?$', 1), '') AS BIGINT) AS doc_no
  FROM p3),
bad AS (SELECT doc_id, quality = 0 OR toxic = 1 AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL),
labelled AS (SELECT host, lex, count(*) AS n_labelled, count(*) FILTER (bad) AS n_bad FROM p JOIN bad ON doc_no = doc_id GROUP BY 1, 2),
t0 AS MATERIALIZED (SELECT p.host, p.lex, string_split(p.lex, '/') AS segs, CASE WHEN p.lex = '' THEN 0 ELSE len(string_split(p.lex, '/')) END AS depth, count(*) AS n,
    coalesce(any_value(n_labelled), 0) AS n_labelled, coalesce(any_value(n_bad), 0) AS n_bad, '' AS template
  FROM p LEFT JOIN labelled l ON l.host = p.host AND l.lex = p.lex GROUP BY ALL),
"""

_CLASS = "CASE WHEN regexp_matches(seg, '^[0-9]+$') THEN '<n>' WHEN regexp_matches(seg, '^[0-9]+[.][A-Za-z]{{1,5}}$') THEN '<n>' || regexp_extract(seg, '[.][A-Za-z]+$', 0) WHEN regexp_matches(seg, '^[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?$') THEN '<date>' WHEN regexp_matches(seg, '^[0-9a-fA-F-]{{8,}}$') THEN '<hex>' ELSE '*' END"

#: One level of the tree: children, nodes, and the rows with the next part of their templates.
_LEVEL = f"""
c{{k}} AS MATERIALIZED (SELECT host, template, segs[{{k}}] AS seg, sum(n_labelled) AS n_l, sum(n_bad) AS n_b FROM t{{j}} WHERE depth >= {{k}} GROUP BY ALL),
m{{k}} AS MATERIALIZED (SELECT host, template, (sum(n_bad) + 1.0::DOUBLE) / (sum(n_labelled) + 2.0::DOUBLE) AS pooled FROM t{{j}} GROUP BY ALL),
s{{k}} AS MATERIALIZED (SELECT c.host, c.template, seg, CASE WHEN abs(n_b - n_l * pooled) > 1.96::DOUBLE * sqrt((n_l + 4.0::DOUBLE) * pooled * (1.0::DOUBLE - pooled))
    THEN CASE WHEN regexp_matches(seg, '^[=*<]') THEN '=' || seg ELSE seg END ELSE {_CLASS} END AS part
  FROM c{{k}} c JOIN m{{k}} m ON m.host = c.host AND m.template = c.template),
t{{k}} AS MATERIALIZED (SELECT t.* EXCLUDE (template), CASE WHEN depth >= {{k}} THEN t.template || '/' || part ELSE t.template END AS template
  FROM t{{j}} t LEFT JOIN s{{k}} s ON s.host = t.host AND s.template = t.template AND s.seg = t.segs[{{k}}] AND t.depth >= {{k}}),
"""

#: The SQL is written out for paths of so many segments, far more than those of the tables; the operator has no such bound.
_LEVELS = 16

_TAIL = """
tree AS (SELECT host, lex, n_labelled, n_bad, CASE WHEN template = '' THEN '/' ELSE template END AS template FROM t{last}),
t AS (SELECT host, template, sum(n_labelled) AS n_l, sum(n_bad) AS n_b FROM tree GROUP BY ALL),
h AS (SELECT host, sum(n_l) AS h_l, sum(n_b) AS h_b FROM t GROUP BY 1),
g AS (SELECT (sum(h_b) + 1.0::DOUBLE) / (sum(h_l) + 2.0::DOUBLE) AS g FROM h),
v AS (SELECT t.host, template, (n_b + 4.0::DOUBLE * ((h_b + 4.0::DOUBLE * g) / (h_l + 4.0::DOUBLE))) / (n_l + 4.0::DOUBLE) >= 0.5 AND n_l > 0 AS blocked FROM t JOIN h USING (host), g)
SELECT p.page_id, p.host, p.path, p.rule, tree.template,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN tree ON tree.host = p.host AND tree.lex = p.lex LEFT JOIN v ON v.host = p.host AND v.template = tree.template
"""

OP1_SQL = _HEAD + "".join(_LEVEL.format(k=k, j=k - 1) for k in range(1, _LEVELS + 1)) + _TAIL.format(last=_LEVELS)
