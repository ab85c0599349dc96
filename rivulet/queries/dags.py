"""Queries of the dependency graph.

The graph is read off the keys: region, nation, customer and supplier, order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import dag
from rivulet.queries import query

E = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def tag(letter, column):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def edges(t, orders=None):
    """The graph of all orders, or of the given ones."""
    orders = t.orders if orders is None else orders
    return dag.edges_of(
        [
            (t.nation, tag("r", "n_regionkey"), tag("n", "n_nationkey")),
            (t.customer, tag("n", "c_nationkey"), tag("c", "c_custkey")),
            (t.supplier, tag("n", "s_nationkey"), tag("s", "s_suppkey")),
            (orders, tag("c", "o_custkey"), tag("o", "o_orderkey")),
        ]
    )


@query("deps_edges", f"WITH {E} SELECT src, dst FROM edges")
def deps_edges(t):
    return edges(t)


@query("dag_indegree", f"WITH {E} SELECT dst, count(*) AS ndeps FROM edges GROUP BY 1")
def dag_indegree(t):
    return dag.indegree(edges(t))


@query("dag_leaves", f"WITH {E} SELECT DISTINCT src AS id FROM edges WHERE src NOT IN (SELECT dst FROM edges)")
def dag_leaves(t):
    return dag.roots(edges(t))


@query("dag_subset", f"WITH {E} SELECT src, dst FROM edges WHERE substr(src, 1, 1) IN ('r', 'n', 's') AND substr(dst, 1, 1) IN ('r', 'n', 's')")
def dag_subset(t):
    e = edges(t)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).where(F.substring("id", 1, 1).isin("r", "n", "s"))
    return dag.induced(e, nodes).select("src", "dst")


@query(
    "dag_upstream",
    f"WITH RECURSIVE {E}, up AS (SELECT 'o0' AS id UNION SELECT 'o' || 200 UNION SELECT src FROM edges JOIN up ON dst = id) SELECT DISTINCT id FROM up",
)
def dag_upstream(t):
    start = t.spark.createDataFrame([("o0",), ("o200",)], "id string")
    return dag.closure(edges(t), start, direction="in").select("id")


@query(
    "dag_neighborhood",
    f"WITH RECURSIVE {E}, nb AS (SELECT 'r1' AS id, 0 AS k UNION ALL SELECT dst, k + 1 FROM edges JOIN nb ON src = id WHERE k < 2) SELECT id, CAST(min(k) AS BIGINT) AS \"order\" FROM nb GROUP BY 1",
)
def dag_neighborhood(t):
    return dag.closure(edges(t), t.spark.createDataFrame([("r1",)], "id string"), max_order=2)


@query(
    "dag_levels",
    f"WITH RECURSIVE {E}, lv AS (SELECT DISTINCT src AS id, 0 AS k FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION ALL SELECT dst, k + 1 FROM edges JOIN lv ON src = id) SELECT id, CAST(max(k) AS BIGINT) AS level FROM lv GROUP BY 1",
)
def dag_levels(t):
    return dag.levels(edges(t))


@query("dag_compose_file", f"WITH {E} SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE b.src LIKE 'n%'")
def dag_compose_file(t):
    return dag.composed(edges(t), F.col("v").startswith("n"))


@query("dag_elide_vertex", f"WITH {E} SELECT src, dst FROM edges WHERE src NOT LIKE 'n%' AND dst NOT LIKE 'n%' UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE b.src LIKE 'n%'")
def dag_elide_vertex(t):
    return dag.elide(edges(t), F.col("id").startswith("n"))


BACK = "back AS (SELECT * FROM edges UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_orderkey % 60 = 0)"


@query("dag_cycles", f"WITH {E}, {BACK} SELECT DISTINCT a.src AS id FROM back a JOIN back b ON a.src = b.dst AND a.dst = b.src")
def dag_cycles(t):
    """Some orders point back to their customers."""
    back = t.orders.where("o_orderkey % 60 = 0").select(tag("o", "o_orderkey").alias("src"), tag("c", "o_custkey").alias("dst"))
    return dag.cyclic(edges(t).unionByName(back).distinct())


LV = f"WITH RECURSIVE {E}, lv AS (SELECT DISTINCT src AS id, 0 AS k FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION ALL SELECT dst, k + 1 FROM edges JOIN lv ON src = id), l AS (SELECT id, max(k) AS level FROM lv GROUP BY 1)"
STATUS = "CASE WHEN substr(id, 1, 1) = 'r' THEN 'imported' WHEN substr(id, 1, 1) = 'o' AND CAST(substr(id, 2) AS BIGINT) % 3 = 0 THEN 'failed' WHEN substr(id, 1, 1) = 'c' AND CAST(substr(id, 2) AS BIGINT) % 7 = 0 THEN 'outdated' WHEN substr(id, 1, 1) = 's' THEN 'missing' ELSE 'up to date' END"
TYPE = "CASE WHEN substr(id, 1, 1) = 'r' THEN 'function' WHEN substr(id, 1, 1) = 'n' THEN 'file' WHEN substr(id, 1, 1) = 'c' THEN 'dynamic' ELSE 'object' END"


def statuses(t):
    """A status for each node; the last rule that holds wins."""
    from rivulet.operators.states import node_status, node_type

    ids = edges(t).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kind, number = F.substring("id", 1, 1), F.expr("CAST(substring(id, 2) AS BIGINT)")
    status = node_status(imported=kind == "r", missing=kind == "s", outdated=(kind == "c") & (number % 7 == 0), failed=(kind == "o") & (number % 3 == 0))
    return ids.select("id", status.alias("status"), node_type(dynamic=kind == "c", file=kind == "n", function=kind == "r").alias("type"))


@query("graph_nodes", f"{LV} SELECT id, level, {STATUS} AS status, {TYPE} AS type FROM (SELECT id, CAST(level AS BIGINT) AS level FROM l)")
def graph_nodes(t):
    return dag.levels(edges(t)).join(statuses(t), "id").select("id", "level", "status", "type")


@query(
    "graph_clusters",
    f"""WITH {E}, ids AS (SELECT DISTINCT unnest([src, dst]) AS id FROM edges), c AS (SELECT id, CASE WHEN {STATUS} = 'up to date' THEN 'done' ELSE id END AS cl FROM ids)
SELECT DISTINCT a.cl AS "from", b.cl AS "to" FROM edges JOIN c a ON a.id = src JOIN c b ON b.id = dst WHERE a.cl <> b.cl""",
)
def graph_clusters(t):
    """All nodes that are up to date as one cluster."""
    nodes = statuses(t).select("id", F.when(F.col("status") == "up to date", "done").alias("by"), F.lit(0).alias("rank"))
    return dag.clustered(nodes, edges(t), "by")[1]


@query(
    "graph_coords",
    f"""{LV} SELECT id, CAST(level AS BIGINT) AS level, round(-1.0::DOUBLE + 2.0::DOUBLE * level / max(level) OVER (), 6) AS x,
round(CASE WHEN count(*) OVER (PARTITION BY level) > 1 THEN -1.0::DOUBLE + 2.0::DOUBLE * (row_number() OVER (PARTITION BY level ORDER BY id) - 1) / (count(*) OVER (PARTITION BY level) - 1) ELSE 0.0::DOUBLE END, 6) AS y FROM l""",
)
def graph_coords(t):
    return dag.coordinates(dag.levels(edges(t)))


TIMES = "times AS (SELECT 'o' || o_orderkey AS id, o_orderkey % 13 + 1 AS t FROM orders UNION ALL SELECT 'c' || c_custkey, c_custkey % 5 + 1 FROM customer UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation)"


def times(t, orders=None):
    orders = t.orders if orders is None else orders
    o = orders.select(tag("o", "o_orderkey").alias("id"), (F.col("o_orderkey") % 13 + 1).alias("time"))
    c = t.customer.select(tag("c", "c_custkey").alias("id"), (F.col("c_custkey") % 5 + 1).alias("time"))
    return o.unionByName(c).unionByName(t.nation.select(tag("n", "n_nationkey").alias("id"), F.lit(2).cast("bigint").alias("time")))


@query("predict_serial", f"WITH {TIMES} SELECT CAST(sum(t) AS BIGINT) AS seconds, count(*) AS targets FROM times")
def predict_serial(t):
    return times(t).agg(F.sum("time").alias("seconds"), F.count("*").alias("targets"))


@query("predict_critical_path", f"WITH RECURSIVE {E}, {TIMES}, f AS (SELECT DISTINCT src AS id, CAST(0 AS BIGINT) AS finish FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION ALL SELECT dst, CAST(finish + coalesce(t, 0) AS BIGINT) FROM edges JOIN f ON src = f.id LEFT JOIN times ON times.id = dst) SELECT max(finish) AS seconds FROM f")
def predict_critical_path(t):
    return dag.longest_path(edges(t), times(t)).agg(F.max("finish").alias("seconds"))


@query(
    "predict_workers",
    f"""{LV}, {TIMES}, n AS (SELECT coalesce(l.id, times.id) AS id, coalesce(level, 0) AS level, coalesce(t, 0) AS t FROM l FULL JOIN times ON times.id = l.id),
c AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY level ORDER BY md5(id), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, sum(t) OVER (PARTITION BY level) AS total FROM n),
w AS (SELECT *, CASE WHEN total = 0 THEN 1 ELSE least(3, cum * 3 // total + 1) END AS worker FROM c),
s AS (SELECT level, worker, min(cum) AS first, sum(t) AS busy FROM w GROUP BY 1, 2),
b AS (SELECT level, coalesce(sum(length) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began FROM (SELECT level, max(busy) AS length FROM s GROUP BY 1))
SELECT id AS target, CAST(w.worker AS INTEGER) AS worker, CAST(began + cum - first AS BIGINT) AS start, CAST(began + cum - first + t AS BIGINT) AS "end"
FROM w JOIN s ON s.level = w.level AND s.worker = w.worker JOIN b ON b.level = w.level""",
)
def predict_workers(t):
    """A schedule of all targets on three workers, level by level."""
    return dag.level_schedule(edges(t), times(t), 3)


@query("tracked", f"WITH {E} SELECT DISTINCT unnest([src, dst]) AS id FROM edges")
def tracked(t):
    return edges(t).select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query("missed", "SELECT DISTINCT 'c' || o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def missed(t):
    """Imports that the graph names and the present tables lack: here, every tenth customer."""
    needed = t.orders.select(tag("c", "o_custkey").alias("id")).distinct()
    return needed.join(t.customer.where("c_custkey % 10 <> 0").select(tag("c", "c_custkey").alias("id")), "id", "left_anti")


@query(
    "outdated",
    f"WITH RECURSIVE {E}, d AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey % 6 = 0 UNION SELECT dst FROM edges JOIN d ON src = id) SELECT DISTINCT id FROM d",
)
def outdated(t):
    """Stale targets and everything downstream of them."""
    stale = t.nation.where("n_nationkey % 6 = 0").select(tag("n", "n_nationkey").alias("id"))
    return dag.closure(edges(t), stale).select("id")
