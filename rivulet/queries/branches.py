"""Queries of dynamic branching."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions.fingerprint import row_fingerprint
from rivulet.functions.names import branch_name
from rivulet.operators import branching as b
from rivulet.queries import query


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


@query("dyn_map_rows", """SELECT row_number() OVER (ORDER BY p_partkey) AS _branch, p_partkey, upper(p_name) AS name_up, p_size * 2 AS size2 FROM part""")
def dyn_map_rows(t):
    return b.map_rows(t.part, "p_partkey", p_partkey=F.col("p_partkey"), name_up=F.upper("p_name"), size2=F.col("p_size") * 2)


@query(
    "dyn_map_zip",
    """SELECT c._branch, c_custkey, s_suppkey, c_nationkey + s_nationkey AS both_nations
FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS _branch FROM customer) c JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS _branch FROM supplier) s USING (_branch)""",
)
def dyn_map_zip(t):
    z = b.zip_map(t.customer, t.supplier, "c_custkey", "s_suppkey", check=False)
    return z.select("_branch", "c_custkey", "s_suppkey", (F.col("c_nationkey") + F.col("s_nationkey")).alias("both_nations"))


CROSS = """SELECT CAST((a.i - 1) * b.n + b.j AS BIGINT) AS _branch, r_name, n_name
FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) a, (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS j, count(*) OVER () AS n FROM nation) b"""


@query("dyn_cross", CROSS)
def dyn_cross(t):
    return b.cross(t.region, t.nation, "r_regionkey", "n_nationkey").select("_branch", "r_name", "n_name")


@query("dyn_trace_cross", CROSS.replace("r_name, n_name", "r_name AS trace_region, n_name AS trace_nation"))
def dyn_trace_cross(t):
    return b.cross(t.region, t.nation, "r_regionkey", "n_nationkey").select("_branch", F.col("r_name").alias("trace_region"), F.col("n_name").alias("trace_nation"))


GROUPS = """SELECT dense_rank() OVER (ORDER BY first) AS _branch, o_orderpriority, n, total, mean FROM (
SELECT o_orderpriority, min(o_orderkey) AS first, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / count(*), 2) AS DECIMAL(18,2)) AS mean FROM orders GROUP BY 1)"""


def grouped_orders(t):
    mean = F.round(F.sum(money("o_totalprice")).cast("double") / F.count("*"), 2).cast("decimal(18,2)")
    return b.group_by(t.orders, "o_orderpriority", "o_orderkey", n=F.count("*"), total=F.sum(money("o_totalprice")), mean=mean)


@query("dyn_group_by", f"SELECT _branch, o_orderpriority AS my_by, n, CAST(total AS DECIMAL(28,2)) AS total FROM ({GROUPS})")
def dyn_group_by(t):
    return grouped_orders(t).select("_branch", F.col("o_orderpriority").alias("my_by"), "n", F.col("total").cast("decimal(28,2)").alias("total"))


@query("dyn_group_mean", f"SELECT _branch, o_orderpriority, n, mean FROM ({GROUPS})")
def dyn_group_mean(t):
    return grouped_orders(t).select("_branch", "o_orderpriority", "n", "mean")


@query("dyn_trace_group", f"SELECT _branch, o_orderpriority AS trace_by FROM ({GROUPS})")
def dyn_trace_group(t):
    first = b.group_numbers(t.orders, "o_orderpriority", "o_orderkey")
    return first.select("_branch", F.col("o_orderpriority").alias("trace_by"))


@query("dyn_group_noby", "SELECT CAST(1 AS BIGINT) AS _branch, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders")
def dyn_group_noby(t):
    return b.group_all(t.orders, n=F.count("*"), total=F.sum(money("o_totalprice")).cast("decimal(28,2)"))


@query(
    "dyn_group_multi",
    """SELECT dense_rank() OVER (ORDER BY min(s_suppkey)) AS _branch, s_nationkey, string_agg(s_suppkey, ',' ORDER BY s_suppkey) AS keys, string_agg(s_name, ',' ORDER BY s_suppkey) AS names
FROM supplier GROUP BY s_nationkey""",
)
def dyn_group_multi(t):
    return b.group_by(t.supplier, "s_nationkey", "s_suppkey", keys=b.ordered_text("s_suppkey", "s_suppkey"), names=b.ordered_text("s_name", "s_suppkey"))


@query(
    "dyn_group_of_map",
    """SELECT dense_rank() OVER (ORDER BY min(o_orderkey)) AS _branch, o_orderstatus, CAST(sum(cents) AS BIGINT) AS cents
FROM (SELECT o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM orders) GROUP BY o_orderstatus""",
)
def dyn_group_of_map(t):
    mapped = t.orders.select("o_orderkey", "o_orderstatus", (money("o_totalprice") * 100).cast("bigint").alias("cents"))
    return b.group_by(mapped, "o_orderstatus", "o_orderkey", cents=F.sum("cents"))


@query("dyn_max_expand", "SELECT * FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS _branch, p_partkey, p_name FROM part) WHERE _branch <= 12")
def dyn_max_expand(t):
    return b.max_expand(b.with_ordinal(t.part, "p_partkey", out="_branch"), 12).select("_branch", "p_partkey", "p_name")


@query(
    "max_expand_spaced",
    """WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS _branch, count(*) OVER () AS n FROM part)
SELECT DISTINCT p_partkey, _branch FROM p, (SELECT unnest(range(5)) AS j) WHERE _branch = 1 + (j * (n - 1)) // 4""",
)
def max_expand_spaced(t):
    return b.max_expand_spaced(b.with_ordinal(t.part, "p_partkey", out="_branch"), 5).select("p_partkey", "_branch")


SUB = """SELECT CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS subtarget, _branch, n_nationkey FROM (
SELECT *, row_number() OVER (PARTITION BY name ORDER BY _branch) AS k FROM (
SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS _branch, 'y_' || substr(md5(n_name || ' ' || n_regionkey), 1, 8) AS name FROM nation))"""


def subtargets(t):
    from rivulet.functions.names import with_unique_names

    rows = b.with_ordinal(t.nation, "n_nationkey", out="_branch").withColumn("name", branch_name("y", "n_name", F.col("n_regionkey").cast("string")))
    return with_unique_names(rows, "name", "_branch", "subtarget")


@query("dyn_subtargets", SUB)
def dyn_subtargets(t):
    return subtargets(t).select("subtarget", "_branch", "n_nationkey")


@query("branch_fingerprint", "SELECT n_nationkey, 'y_' || substr(md5(n_name || ' ' || n_regionkey), 1, 8) AS name FROM nation")
def branch_fingerprint(t):
    return t.nation.select("n_nationkey", branch_name("y", "n_name", F.col("n_regionkey").cast("string")).alias("name"))


@query("dyn_subtarget_select", f"SELECT subtarget, n_nationkey FROM ({SUB}) WHERE _branch IN (2, 5, 7)")
def dyn_subtarget_select(t):
    return subtargets(t).where(F.col("_branch").isin(2, 5, 7)).select("subtarget", "n_nationkey")


@query("dyn_whole", f"SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM ({SUB})")
def dyn_whole(t):
    return subtargets(t).agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("total"))


def row_text_sql(*columns: str) -> str:
    """SQL of the text that a row's fingerprint is of."""
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in columns) + ")"


@query("row_fingerprint", f"SELECT c_custkey, md5({row_text_sql('c_name', 'c_nationkey', 'c_mktsegment')}) AS fingerprint FROM customer")
def row_fingerprints(t):
    return t.customer.select("c_custkey", row_fingerprint("c_name", "c_nationkey", "c_mktsegment").alias("fingerprint"))


KEYS = f"""SELECT c_custkey, c_mktsegment, c_nationkey, md5({row_text_sql("c_mktsegment", "c_nationkey")}) AS _branch_key,
 row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS _occurrence FROM customer"""


def _keyed(df):
    content = ["c_mktsegment", "c_nationkey"]
    return b.branch_keys(df, "c_custkey", content, row_fingerprint(*content))


@query("incremental_branches", f"WITH k AS ({KEYS}), o AS ({KEYS} WHERE c_custkey > 1000) SELECT c_custkey, _branch_key, _occurrence FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o._branch_key = k._branch_key AND o._occurrence = k._occurrence)")
def incremental_branches(t):
    """Branches of today's table that a store built from its rows above key 1000 lacks."""
    return b.new_branches(_keyed(t.customer), _keyed(t.customer.where("c_custkey > 1000"))).select("c_custkey", "_branch_key", "_occurrence")


@query("stale_branches", f"WITH k AS ({KEYS} WHERE c_nationkey <> 3), o AS ({KEYS}) SELECT c_custkey, _branch_key, _occurrence FROM o WHERE NOT EXISTS (SELECT 1 FROM k WHERE o._branch_key = k._branch_key AND o._occurrence = k._occurrence)")
def stale_branches(t):
    """Stored branches that a table without one nation no longer has."""
    return b.new_branches(_keyed(t.customer), _keyed(t.customer.where("c_nationkey <> 3"))).select("c_custkey", "_branch_key", "_occurrence")
