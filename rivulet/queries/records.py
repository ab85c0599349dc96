"""Queries of progress, history, build times, recovery, and the example models."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import branching as b
from rivulet.operators import records as r
from rivulet.queries import query

STATUS = "CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'done' WHEN 'click' THEN 'cancelled' WHEN 'error' THEN 'failed' ELSE 'none' END"
LAST = f"l AS (SELECT user_id AS target, {STATUS} AS status, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)"


def log(t):
    return t.events.select(F.col("user_id").alias("target"), F.expr(STATUS).alias("status"), "event_id", "event_type", "ts", "value", "props")


@query("progress_latest", f"WITH {LAST} SELECT target, status FROM l")
def progress_latest(t):
    return r.latest(log(t).select("target", "status", "ts", "event_id"), "target", "ts", "event_id").select("target", "status")


@query("progress_filter", f"WITH {LAST} SELECT target, status FROM l WHERE status IN ('failed', 'cancelled')")
def progress_filter(t):
    return r.with_progress(progress_latest(t), "status", ["failed", "cancelled"])


@query("latest_meta", f"WITH {LAST} SELECT target, event_id, event_type FROM l")
def latest_meta(t):
    return r.latest(log(t).select("target", "event_id", "event_type", "ts"), "target", "ts", "event_id").select("target", "event_id", "event_type")


@query(
    "history_current",
    f"""WITH {LAST} SELECT e.user_id AS target, e.event_id, e.event_type, l.event_type IS NOT NULL AS "exists", coalesce(e.event_type = l.event_type, false) AS current
FROM events e LEFT JOIN (SELECT * FROM l WHERE target % 10 <> 0) l ON l.target = e.user_id""",
)
def history_current(t):
    now = latest_meta(t).where("target % 10 <> 0").select("target", "event_type")
    return r.history(log(t).select("target", "event_id", "event_type"), now, "target", "event_type")


@query("history_args", r"""SELECT event_id, CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS BIGINT) AS k FROM events""")
def history_args(t):
    return t.events.select("event_id", F.try_to_number(F.nullif(F.regexp_extract("props", r'"k": *([0-9]+)', 1), F.lit("")), F.lit("999999999")).cast("bigint").alias("k"))


@query(
    "build_times",
    "SELECT user_id AS target, CAST(CASE WHEN s >= 60 THEN round(s, 0) ELSE round(s, 3) END AS DECIMAL(18,3)) AS elapsed FROM (SELECT user_id, sum(CAST(value AS DECIMAL(18,3))) / 10 AS s0, CAST(sum(CAST(value AS DECIMAL(18,3))) AS DECIMAL(18,3)) AS s FROM events WHERE event_type <> 'error' GROUP BY 1)",
)
def build_times(t):
    total = t.events.where("event_type <> 'error'").groupBy(F.col("user_id").alias("target")).agg(F.sum(F.col("value").cast("decimal(18,3)")).cast("decimal(18,3)").alias("s"))
    return total.select("target", r.build_seconds(F.col("s")).alias("elapsed"))


@query("cache_log", "SELECT md5(c_name) AS hash, CASE WHEN c_custkey % 5 = 0 THEN 'import' ELSE 'target' END AS type, c_name AS name FROM customer")
def cache_log(t):
    return t.customer.select(F.md5("c_name").alias("hash"), F.when(F.col("c_custkey") % 5 == 0, "import").otherwise("target").alias("type"), F.col("c_name").alias("name"))


@query("dyn_times", "SELECT c_nationkey AS target, count(*) AS subtargets, CAST(sum(n) AS BIGINT) AS builds FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def dyn_times(t):
    builds = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = t.customer.join(builds, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("target")).agg(F.count("*").alias("subtargets"), F.sum("n").alias("builds"))


@query("cached_planned", "SELECT c_custkey AS name FROM customer INTERSECT SELECT o_custkey FROM orders")
def cached_planned(t):
    return t.customer.select(F.col("c_custkey").alias("name")).intersect(t.orders.select("o_custkey"))


@query("cached_unplanned", "SELECT c_custkey AS name FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def cached_unplanned(t):
    return t.customer.select(F.col("c_custkey").alias("name")).subtract(t.orders.where("o_orderkey % 3 = 0").select("o_custkey"))


@query("gc_unreferenced", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def gc_unreferenced(t):
    index = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return r.unreferenced(t.customer.select("c_custkey"), index, "c_custkey")


@query("recover_latest", "SELECT key, event_id, value FROM (SELECT event_type || '-' || user_id AS key, event_id, CAST(value AS DECIMAL(18,2)) AS value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND key LIKE 'view-%'")
def recover_latest(t):
    stored = t.events.select(F.concat_ws("-", "event_type", "user_id").alias("key"), "event_id", F.col("value").cast("decimal(18,2)").alias("value"), "ts")
    wanted = t.events.select(F.concat(F.lit("view-"), "user_id").alias("key")).distinct()
    return r.recoverable(wanted, stored, "key", "ts", "event_id").select("key", "event_id", "value")


@query("select_helpers", "SELECT p_partkey, starts_with(p_name, 'red') AS a, ends_with(p_name, 'ring') AS b, contains(p_name, 'wid') AS c, regexp_matches(p_name, '^[a-m].*g') AS d, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS e FROM part")
def select_helpers(t):
    n = F.col("p_name")
    return t.part.select(
        "p_partkey", r.starts_with(n, "red").alias("a"), r.ends_with(n, "ring").alias("b"), r.contains(n, "wid").alias("c"), r.matches(n, "^[a-m].*g").alias("d"), r.num_range(F.col("p_brand"), "Brand#", range(1, 4)).alias("e")
    )


@query("longest_match", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'red wid') THEN 'red wid' WHEN starts_with(p_name, 'small') THEN 'small' WHEN starts_with(p_name, 'red') THEN 'red' END AS handle FROM part")
def longest_match(t):
    return t.part.select("p_partkey", r.longest_match(F.col("p_name"), ["red", "small", "red wid"]).alias("handle"))


@query("regression_linear", "SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, count(*) AS n FROM part")
def regression_linear(t):
    return t.part.agg(F.round(F.regr_slope("p_retailprice", "p_size"), 6).alias("slope"), F.round(F.regr_intercept("p_retailprice", "p_size"), 4).alias("intercept"), F.count("*").alias("n"))


@query("regression_square", "SELECT round(regr_slope(p_retailprice, p_size * p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size * p_size), 4) AS intercept FROM part")
def regression_square(t):
    x = (F.col("p_size") * F.col("p_size")).cast("double")
    return t.part.agg(F.round(F.regr_slope("p_retailprice", x), 6).alias("slope"), F.round(F.regr_intercept("p_retailprice", x), 4).alias("intercept"))


RES = "SELECT p_retailprice - (i + s * p_size) AS e FROM part, (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part)"


@query("residual_summary", f"SELECT round(min(e), 3) AS e_min, round(quantile_cont(e, 0.25), 3) AS q1, round(quantile_cont(e, 0.5), 3) AS median, round(avg(e), 3) + 0.0 AS mean, round(quantile_cont(e, 0.75), 3) AS q3, round(max(e), 3) AS e_max FROM ({RES})")
def residual_summary(t):
    fit = t.part.agg(F.regr_slope("p_retailprice", "p_size").alias("s"), F.regr_intercept("p_retailprice", "p_size").alias("i"))  # one row
    e = t.part.join(F.broadcast(fit)).select((F.col("p_retailprice") - (F.col("i") + F.col("s") * F.col("p_size"))).alias("e"))
    q = lambda p: F.round(F.percentile("e", F.lit(p)), 3)
    return e.agg(F.round(F.min("e"), 3).alias("e_min"), q(0.25).alias("q1"), q(0.5).alias("median"), (F.round(F.avg("e"), 3) + F.lit(0.0)).alias("mean"), q(0.75).alias("q3"), F.round(F.max("e"), 3).alias("e_max"))


@query("seeded_sample", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 64")
def seeded_sample(t):
    return r.seeded_sample(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 7, 64)


@query("seeded_draws", "SELECT d AS draw, p_partkey FROM (SELECT unnest(range(1, 49)) AS d) JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i, count(*) OVER () AS n FROM part) ON i = CAST('0x' || substr(md5('7:' || d), 1, 8) AS BIGINT) % n + 1")
def seeded_draws(t):
    """Rows drawn with replacement, as the example workflow does."""
    return r.seeded_draws(b.with_ordinal(t.part.select("p_partkey"), "p_partkey"), "_ord", 7, 48).select("draw", "p_partkey")
