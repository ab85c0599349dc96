"""Queries of triggers, dependency fingerprints and invalidation.

The old state is ``documents`` as it is; the new state has edits in known places.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import states as s
from rivulet.queries import query

OLD = """old AS (SELECT doc_id, md5(source) AS command, md5(lang) AS depend, md5(text) AS file_in, 'parquet' AS format, CAST(n_chars AS BIGINT) AS seed, CAST(10 AS BIGINT) AS max_expand FROM documents)"""
NEW = """new AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN md5(source || '!') ELSE md5(source) END AS command, CASE WHEN doc_id % 19 = 0 THEN md5('x' || lang) ELSE md5(lang) END AS depend,
 CASE WHEN doc_id % 23 = 0 THEN NULL ELSE md5(text) END AS file_in, CASE WHEN doc_id % 29 = 0 THEN 'orc' WHEN doc_id % 31 = 0 THEN NULL ELSE 'parquet' END AS format,
 CAST(n_chars + CASE WHEN doc_id % 37 = 0 THEN 1 ELSE 0 END AS BIGINT) AS seed, CAST(CASE WHEN doc_id % 41 = 0 THEN 20 ELSE 10 END AS BIGINT) AS max_expand FROM documents WHERE doc_id % 43 <> 0)"""
BOTH = f"WITH {OLD}, {NEW}, m AS (SELECT n.doc_id, " + ", ".join(f"o.{c} AS old_{c}, n.{c} AS new_{c}" for c in ("command", "depend", "file_in", "format", "seed", "max_expand")) + " FROM new n JOIN old o ON o.doc_id = n.doc_id)"
FIELDS = ["command", "depend", "file_in", "format", "seed", "max_expand"]


def sides(t):
    """Both states; the file fingerprint is that of the whole text."""
    d = t.documents
    file_in = F.md5("text")
    at = lambda k: F.col("doc_id") % k == 0
    old = d.select("doc_id", F.md5("source").alias("command"), F.md5("lang").alias("depend"), file_in.alias("file_in"), F.lit("parquet").alias("format"), F.col("n_chars").cast("bigint").alias("seed"), F.lit(10).cast("bigint").alias("max_expand"))
    new = d.where("doc_id % 43 <> 0").select(
        "doc_id",
        F.when(at(17), F.md5(F.concat("source", F.lit("!")))).otherwise(F.md5("source")).alias("command"),
        F.when(at(19), F.md5(F.concat(F.lit("x"), "lang"))).otherwise(F.md5("lang")).alias("depend"),
        F.when(~at(23), file_in).alias("file_in"),
        F.when(at(29), "orc").when(~at(31), "parquet").alias("format"),
        (F.col("n_chars") + F.when(at(37), 1).otherwise(0)).cast("bigint").alias("seed"),
        F.when(at(41), 20).otherwise(10).cast("bigint").alias("max_expand"),
    )
    return old, new


def joined(t):
    old, new = sides(t)
    return new.select("doc_id", *[F.col(c).alias(f"new_{c}") for c in FIELDS]).join(old.select("doc_id", *[F.col(c).alias(f"old_{c}") for c in FIELDS]), "doc_id")


def _fires(field: str):
    def f(t):
        return joined(t).where(s.changed(F.col(f"old_{field}"), F.col(f"new_{field}"))).select("doc_id")

    return f


for _name, _field in (("trigger_command", "command"), ("trigger_depend", "depend"), ("trigger_file", "file_in"), ("trigger_seed", "seed"), ("trigger_dynamic", "max_expand")):
    query(_name, f"{BOTH} SELECT doc_id FROM m WHERE old_{_field} IS DISTINCT FROM new_{_field}")(_fires(_field))


@query("trigger_format", f"{BOTH} SELECT doc_id FROM m WHERE old_format <> new_format")
def trigger_format(t):
    return joined(t).where(s.format_changed(F.col("old_format"), F.col("new_format"))).select("doc_id")


@query("trigger_missing", f"WITH {OLD}, {NEW} SELECT doc_id FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def trigger_missing(t):
    old, new = sides(t)
    return old.join(new, "doc_id", "left_anti").select("doc_id")


@query("trigger_imported", "SELECT doc_id, lang = 'en' AS imported, true AS rebuild FROM documents WHERE lang = 'en'")
def trigger_imported(t):
    """Imports are always processed."""
    return t.documents.where("lang = 'en'").select("doc_id", F.lit(True).alias("imported"), F.lit(True).alias("rebuild"))


@query("trigger_change", "SELECT l.doc_id FROM labels l JOIN (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 1 - quality ELSE quality END AS stored FROM labels) o ON o.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM o.stored")
def trigger_change(t):
    """The value of a user's expression (here: the label) differs from the stored one."""
    stored = t.labels.select("doc_id", F.when(F.col("doc_id") % 11 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("stored"))
    return t.labels.join(stored, "doc_id").where(s.changed(F.col("stored"), F.col("quality"))).select("doc_id")


@query(
    "trigger_modes",
    f"""{BOTH} SELECT m.doc_id, toxic = 1 OR old_command IS DISTINCT FROM new_command AS whitelist, toxic = 1 AND old_command IS DISTINCT FROM new_command AS blacklist, toxic = 1 AS condition
FROM m JOIN labels l ON l.doc_id = m.doc_id""",
)
def trigger_modes(t):
    m = joined(t).join(t.labels, "doc_id")
    condition, others = F.col("toxic") == 1, s.changed(F.col("old_command"), F.col("new_command"))
    return m.select("doc_id", *[s.decide(condition, others, mode).alias(mode) for mode in ("whitelist", "blacklist", "condition")])


@query("deps_profile", f"{BOTH} " + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS name, old_{c} IS DISTINCT FROM new_{c} AS changed, old_{c} AS old, new_{c} AS new FROM m" for c in ("command", "depend", "file_in", "format")))
def deps_profile(t):
    old, new = sides(t)
    return s.dependency_profile(old, new, "doc_id", ["command", "depend", "file_in", "format"]).select("doc_id", "name", "changed", "old", "new")


@query("deps_with_hash", "SELECT 'c' || o_custkey AS target, md5(string_agg(DISTINCT h, '' ORDER BY h)) AS dependency_hash FROM (SELECT o_custkey, md5(o_orderpriority || o_orderstatus) AS h FROM orders) GROUP BY o_custkey")
def deps_with_hash(t):
    """A customer depends on the contents of the customer's orders."""
    deps = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("target"), F.md5(F.concat("o_orderpriority", "o_orderstatus")).alias("hash"))
    return s.dependency_hash(deps)


@query("deps_regex", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+[.](?:csv|json|txt|org|com)')) AS n, array_to_string(regexp_extract_all(text, '[A-Za-z]+[.](?:csv|json|txt|org|com)'), ',') AS paths FROM documents WHERE regexp_matches(text, '[A-Za-z]+[.](?:csv|json|txt|org|com)')")
def deps_regex(t):
    """File and site names that a text mentions."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z]+[.](?:csv|json|txt|org|com)"), F.lit(0))
    return t.documents.select("doc_id", F.size(found).cast("bigint").alias("n"), F.array_join(found, ",").alias("paths")).where("n > 0")
