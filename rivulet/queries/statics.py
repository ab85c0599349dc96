"""Queries of the static grammar, expressed on data."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions.names import sanitize_name, with_unique_names
from rivulet.operators import branching as b
from rivulet.operators import planalgebra as pa
from rivulet.plans.inline import evaluate
from rivulet.plans.plan import Plan, Target, combine_, cross_, map_
from rivulet.plans.wildcards import reduce_plan
from rivulet.queries import query
from rivulet.queries.branches import money


TOTAL = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total"


@query("static_map_grid", "SELECT 'f_' || n_name || '_' || n_regionkey AS target, 'f(' || n_name || ', ' || n_regionkey || ')' AS command FROM nation")
def static_map_grid(t):
    return pa.map_grid(t.nation, "f", ["n_name", "n_regionkey"])


@query(
    "static_cross_grid",
    """SELECT CAST((b.j - 1) * a.n + a.i AS BIGINT) AS _branch, r_name, n_name
FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS i, count(*) OVER () AS n FROM region) a, (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS j FROM nation) b""",
)
def static_cross_grid(t):
    return b.cross(t.region, t.nation, "r_regionkey", "n_nationkey", first_slowest=False).select("_branch", "r_name", "n_name")


@query("static_data_grid", "SELECT n_name, r_name FROM (SELECT DISTINCT n_name FROM nation), (SELECT DISTINCT r_name FROM region)")
def static_data_grid(t):
    """Columns of a grid are crossed one by one."""
    grid = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    return pa.cross_columns(grid, ["n_name", "r_name"])


@query("static_split_ntile", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS BIGINT) AS _slice FROM orders")
def static_split_ntile(t):
    return b.split(t.orders, 7, "o_orderkey").select("o_orderkey", "_slice")


@query("slice_rows", "SELECT * EXCLUDE (s) FROM (SELECT p_partkey, p_name, ntile(9) OVER (ORDER BY p_partkey) AS s FROM part) WHERE s = 4")
def slice_rows(t):
    return b.split(t.part, 9, "p_partkey").where("_slice = 4").select("p_partkey", "p_name")


@query("slice_cols", "SELECT p_brand, p_type FROM part")
def slice_cols(t):
    return pa.slice_columns(t.part, 3, 2)


@query("static_combine", "SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders")
def static_combine(t):
    plan = Plan(
        piece=Target("SELECT * FROM orders WHERE pmod(o_orderkey, 3) = i", map_(i=[0, 1, 2])),
        whole=Target(f"SELECT count(*) AS n, {TOTAL} FROM piece", combine_("piece")),
    )
    return evaluate(plan, t.spark, "whole", orders=t.orders)


@query("static_combine_by", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders GROUP BY 1")
def static_combine_by(t):
    """A family for each status and piece, combined by status."""
    statuses = [f"'{r[0]}'" for r in t.orders.select("o_orderstatus").distinct().collect()]  # what to branch over
    plan = Plan(
        piece=Target("SELECT * FROM orders WHERE o_orderstatus = st AND pmod(o_orderkey, 2) = i", cross_(st=statuses, i=[0, 1])),
        each=Target(f"SELECT any_value(o_orderstatus) AS o_orderstatus, count(*) AS n, {TOTAL} FROM piece", combine_("piece", by="st")),
        all=Target("SELECT * FROM each", combine_("each")),
    )
    return evaluate(plan, t.spark, "all", orders=t.orders)


@query("static_combine_multi", "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def static_combine_multi(t):
    plan = Plan(
        c=Target("SELECT c_nationkey AS nation FROM customer WHERE pmod(c_custkey, 2) = k", map_(k=[0, 1])),
        s=Target("SELECT s_nationkey AS nation FROM supplier WHERE pmod(s_suppkey, 2) = k", map_(k=[0, 1])),
        people=Target("SELECT nation, count(*) AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM s) GROUP BY nation", combine_("c", "s")),
    )
    return evaluate(plan, t.spark, "people", customer=t.customer, supplier=t.supplier)


@query(
    "combine_tagalong",
    """SELECT n_regionkey, count(*) AS n, CASE WHEN count(DISTINCT r_name) = 1 AND count(r_name) = count(*) THEN min(r_name) END AS r_name, CASE WHEN count(DISTINCT n_name) = 1 AND count(n_name) = count(*) THEN min(n_name) END AS n_name
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def combine_tagalong(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return pa.combine_tagalong(rows, ["n_regionkey"], ["r_name", "n_name"])


@query("split_combine_agg", "SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, max(o_orderkey) AS last FROM orders")
def split_combine_agg(t):
    partial = b.split(t.orders, 4, "o_orderkey").groupBy("_slice").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("total"), F.max("o_orderkey").alias("last"))
    return partial.agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,2)").alias("total"), F.max("last").alias("last"))


@query("tag_union", "SELECT 'customer' AS tag_in, 'people_' || c_custkey AS tag_out, c_name AS name FROM customer UNION ALL SELECT 'supplier', 'people_' || s_suppkey, s_name FROM supplier")
def tag_union(t):
    c = t.customer.select(F.lit("customer").alias("tag_in"), F.concat(F.lit("people_"), "c_custkey").alias("tag_out"), F.col("c_name").alias("name"))
    s = t.supplier.select(F.lit("supplier").alias("tag_in"), F.concat(F.lit("people_"), "s_suppkey").alias("tag_out"), F.col("s_name").alias("name"))
    return b.bind(c, s)


@query("branch_naming", "SELECT concat_ws('_', 'model', p_brand, p_type, CAST(p_size AS VARCHAR)) AS target, p_partkey FROM part")
def branch_naming(t):
    return t.part.select(F.concat_ws("_", F.lit("model"), "p_brand", "p_type", F.col("p_size").cast("string")).alias("target"), "p_partkey")


@query("make_unique", "SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '_' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def unique_names(t):
    return with_unique_names(t.part, "p_name", "p_partkey", "unique_name").select("p_partkey", "unique_name")


@query(
    "name_sanitize",
    r"""SELECT p_partkey, regexp_replace(CASE WHEN regexp_matches(n, '^([0-9_]|[.][0-9])') THEN 'X' || n ELSE n END, '[.]$', '_') AS name
FROM (SELECT p_partkey, regexp_replace(trim(p_size || ' ' || p_name || '#' || p_type || '.'), '[^A-Za-z0-9_.]', '.', 'g') AS n FROM part)""",
)
def name_sanitize(t):
    raw = F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit("#"), "p_type", F.lit("."))
    return t.part.select("p_partkey", sanitize_name(raw).alias("name"))


@query("trace_left_join", "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN (SELECT r_regionkey, min(r_name) AS r_name FROM region WHERE r_regionkey <> 2 GROUP BY 1) ON n_regionkey = r_regionkey")
def trace_left_join(t):
    right = t.region.where("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return pa.trace_join(t.nation, right, ["n_regionkey"]).select("n_nationkey", "n_name", "r_name")


@query(
    "plan_bind",
    "SELECT c_name AS target, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS BIGINT) AS suppkey FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey FROM supplier",
)
def plan_bind(t):
    c = t.customer.select(F.col("c_name").alias("target"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_name").alias("target"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("suppkey"))
    return b.bind(c, s)


@query("wildcard_expand", "SELECT n_name || '_' || r_name AS target, replace('analyze(n__, r__)', 'r__', r_name) AS command FROM nation, region".replace("replace('analyze(n__, r__)'", "replace(replace('analyze(n__, r__)', 'n__', n_name)"))
def wildcard_expand(t):
    plan = t.nation.select(F.col("n_name").alias("target"), F.expr("replace('analyze(n__, r__)', 'n__', n_name)").alias("command"))
    return pa.evaluate_wildcard(plan, "r__", t.region.select(F.col("r_name").alias("value")))


@query("gather_by", "SELECT 'gather_' || n_regionkey AS target, 'c(' || string_agg(n_name || ' = ' || n_name, ', ' ORDER BY n_nationkey) || ')' AS command FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY n_regionkey")
def gather_by(t):
    return pa.gather_by(t.nation, "n_regionkey", "n_name", "n_nationkey", "c", keep=F.col("n_nationkey") % 4 != 0)


@query("reduce_by", "SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS total, string_agg(n_name, ' + ' ORDER BY n_nationkey) AS command FROM nation GROUP BY 1")
def reduce_by(t):
    return t.nation.groupBy("n_regionkey").agg(F.sum("n_nationkey").alias("total"), b.ordered_text("n_name", "n_nationkey", " + ").alias("command"))


@query("reduce_pairwise", "SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, count(*) - 1 AS steps FROM customer")
def reduce_pairwise(t):
    """Eight pieces reduced two by two; within a piece Spark's own partial aggregation is the tree."""
    pieces = [{"target": f"piece_{i}", "command": f"SELECT sum(CAST(c_acctbal AS DECIMAL(18,2))) AS total, count(*) AS n FROM customer WHERE pmod(c_custkey, 8) = {i}"} for i in range(8)]
    steps = reduce_plan(pieces, "all", begin="SELECT sum(total) AS total, sum(n) AS n FROM (SELECT * FROM ", op=" UNION ALL SELECT * FROM ", end=")")
    plan = Plan({r["target"]: r["command"] for r in [*pieces, *steps]})
    return evaluate(plan, t.spark, "all", customer=t.customer).select(F.col("total").cast("decimal(28,2)").alias("total"), (F.col("n") - 1).alias("steps"))
