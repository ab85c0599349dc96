"""Graph operators over a table of edges (``src``, ``dst``).

Closures go level by level: each round joins the newest frontier with the edges
and keeps what was not reached before, so diamonds do not multiply paths and
cycles end. Each round is written once to the shared folder. A round limit that
is reached with work left is an error, never a part of the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.sources.scratch import materialise


def edges_of(pairs: list[tuple[DataFrame, Column, Column]]) -> DataFrame:
    """One table of edges from (table, source name, target name) triples; null ends are left out."""
    out = None
    for df, src, dst in pairs:
        part = df.select(src.alias("src"), dst.alias("dst")).dropna()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _kept(df: DataFrame) -> DataFrame:
    return materialise(df, "graph")


def _ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def closure(edges: DataFrame, start: DataFrame, max_order: int | None = None, direction: str = "out") -> DataFrame:
    """(id, order): every node within ``max_order`` steps of the starting nodes, and how many steps.

    ``direction`` is out (downstream), in (upstream) or all.
    """
    forward = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    backward = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    step = {"out": forward, "in": backward, "all": forward.unionByName(backward)}[direction]
    frontier = _kept(start.select(F.col(start.columns[0]).alias("id")).distinct().withColumn("order", F.lit(0)))
    reached, order = frontier, 0
    while max_order is None or order < max_order:
        order += 1
        following = step.join(frontier, step["a"] == frontier["id"], "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = _kept(following.join(reached.select("id"), "id", "left_anti").withColumn("order", F.lit(order)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.withColumn("order", F.col("order").cast("bigint"))


def levels(edges: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(id, level): the longest path from a root, by peeling the nodes without unpeeled parents.

    Raises ValueError where a cycle keeps nodes from being peeled, and
    RuntimeError where nodes are left after ``max_levels``.
    """
    left = _kept(edges.select("src", "dst").distinct())
    free = _kept(roots(left))
    done, level = None, 0
    while not free.isEmpty():
        if level == max_levels:
            raise RuntimeError(f"no end after {max_levels} levels")
        found = free.withColumn("level", F.lit(level).cast("bigint"))
        done = found if done is None else done.unionByName(found)
        peeled = left.join(free.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        left = _kept(left.join(free.withColumnRenamed("id", "src"), "src", "left_anti"))
        free = _kept(peeled.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        level += 1
    if not left.isEmpty():
        raise ValueError("the graph has a cycle")
    return done if done is not None else free.withColumn("level", F.lit(0).cast("bigint"))


def _trimmed(edges: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, int]:
    """Edges from a node with parents to a node with children, again and again, and their number."""
    rest, done = _kept(edges), 0
    n = rest.count()
    while n:
        if done == max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        done += 1
        rest = _kept(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        n, before = rest.count(), n
        if n == before:
            break
    return rest, n


def strong_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, component): nodes on cycles and the largest node of their strong component.

    Each round hands every node the largest node that reaches it; where a node
    got itself, those it reaches backwards with the same label are its component.
    Components are taken out and the rest is gone over again. Raises RuntimeError
    where nodes are left after ``max_rounds`` rounds of that or of trimming loose ends.
    """
    own_loops = _kept(edges.where("src = dst").select(F.col("src").alias("id")).distinct())
    rest, n = _trimmed(edges.where("src <> dst").select("src", "dst").distinct(), max_rounds)
    out, done = own_loops.withColumn("component", F.col("id")), 0
    while n:
        if done == max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        done += 1
        label = _kept(_ids(rest).withColumn("label", F.col("id")))
        changed = label
        while not changed.isEmpty():  # only nodes with a new label pass it on
            offered = rest.join(changed, rest["src"] == changed["id"]).groupBy("dst").agg(F.max("label").alias("offer"))
            better = label.join(offered, label["id"] == offered["dst"]).where("offer > label")
            changed = _kept(better.select("id", F.col("offer").alias("label")))
            label = _kept(label.join(changed.withColumnRenamed("label", "new"), "id", "left").select("id", F.coalesce("new", "label").alias("label")))
        of = [label.select(F.col("id").alias(e), F.col("label").alias(f"{e}_label")) for e in ("src", "dst")]
        within = _kept(rest.join(of[0], "src").join(of[1], "dst").where("src_label = dst_label").select("src", "dst"))
        found = closure(within, label.where("id = label"), direction="in").select("id").join(label, "id")
        found = _kept(found.select("id", F.col("label").alias("component")))
        sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        out = out.join(found.select("id"), "id", "left_anti").unionByName(found.join(sizes, "component", "left_semi").select("id", "component")).unionByName(
            own_loops.join(found.join(sizes, "component", "left_anti"), "id", "left_semi").withColumn("component", F.col("id"))
        )
        gone = found.select("id")
        rest, n = _trimmed(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), max_rounds)
    return out


def cyclic(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id): the nodes that lie on a cycle."""
    return strong_components(edges, max_rounds).select("id").distinct()


def indegree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("ndeps"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that nothing points to."""
    return edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes (one column)."""
    n = nodes.columns[0]
    return edges.join(nodes.select(F.col(n).alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col(n).alias("dst")).distinct(), "dst", "left_semi")


def elide(edges: DataFrame, gone: Column) -> DataFrame:
    """Edges without the vertices for which ``gone`` (over ``id``) holds.

    A path that leads from a vertex to another through such vertices only,
    however many, stays as one edge.
    """
    lost = _kept(_ids(edges).where(gone))
    marked = edges.select("src", "dst").join(lost.select(F.col("id").alias("src"), F.lit(True).alias("from_lost")), "src", "left")
    marked = _kept(marked.join(lost.select(F.col("id").alias("dst"), F.lit(True).alias("to_lost")), "dst", "left").select("src", "dst", F.coalesce("from_lost", F.lit(False)).alias("from_lost"), F.coalesce("to_lost", F.lit(False)).alias("to_lost")))
    inner = marked.where("from_lost AND to_lost").select(F.col("src").alias("v"), F.col("dst").alias("w"))
    frontier = _kept(marked.where("NOT from_lost AND to_lost").select(F.col("src").alias("a"), F.col("dst").alias("v")).distinct())
    reached = frontier
    while not inner.isEmpty() and not frontier.isEmpty():
        frontier = _kept(frontier.join(inner, "v").select("a", F.col("w").alias("v")).distinct().join(reached, ["a", "v"], "left_anti"))
        reached = reached.unionByName(frontier)
    out = marked.where("from_lost AND NOT to_lost").select(F.col("src").alias("v"), F.col("dst").alias("b"))
    bridged = reached.join(out, "v").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return marked.where("NOT from_lost AND NOT to_lost").select("src", "dst").unionByName(bridged).distinct()


def composed(edges: DataFrame, through: Column) -> DataFrame:
    """Edges from what produces to what consumes a vertex for which ``through`` (over ``v``) holds."""
    a = edges.select(F.col("src").alias("a"), F.col("dst").alias("v"))
    b = edges.select(F.col("src").alias("v"), F.col("dst").alias("b"))
    return a.join(b, "v").where(through).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def clustered(nodes: DataFrame, edges: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ``by``, rank) collapsed to clusters with their worst (largest) rank, and edges between different clusters."""
    named = nodes.withColumn("cluster", F.coalesce(F.col(by).cast("string"), F.col("id")))
    merged = named.groupBy("cluster").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    of = named.select("id", "cluster")
    e = edges.join(of.select(F.col("id").alias("src"), F.col("cluster").alias("from")), "src").join(of.select(F.col("id").alias("dst"), F.col("cluster").alias("to")), "dst")
    return merged, e.where(F.col("from") != F.col("to")).select("from", "to").distinct()


def coordinates(level: DataFrame) -> DataFrame:
    """(id, level, x, y): x from -1 to 1 by level, y spread evenly within a level."""
    ends = level.agg(F.min("level").alias("lo"), F.max("level").alias("hi"))  # one row
    x = F.when(F.col("hi") > F.col("lo"), -1.0 + 2.0 * (F.col("level") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    w = Window.partitionBy("level")
    k, n = F.row_number().over(w.orderBy("id")), F.count("*").over(w)
    y = F.when(n > 1, -1.0 + 2.0 * (k - 1) / (n - 1)).otherwise(0.0)
    return level.join(F.broadcast(ends)).select("id", "level", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def longest_path(edges: DataFrame, times: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(id, finish): earliest finish of each node (id, time) with unlimited workers."""
    order = levels(edges, max_levels)
    timed = _kept(order.join(times, "id", "left").withColumn("time", F.coalesce("time", F.lit(0))))
    top = timed.agg(F.max("level")).first()[0]
    done = _kept(timed.where("level = 0").select("id", F.col("time").alias("finish")))
    for k in range(1, (top or 0) + 1):
        ready = edges.join(done, edges["src"] == done["id"]).groupBy("dst").agg(F.max("finish").alias("start"))
        done = _kept(done.unionByName(timed.where(F.col("level") == k).join(ready, F.col("id") == F.col("dst")).select("id", (F.col("time") + F.col("start")).alias("finish"))))
    return done


def level_schedule(edges: DataFrame, times: DataFrame, workers: int, digits: int = 3) -> DataFrame:
    """(target, worker, start, end) on so many workers, one level of the graph after the other.

    ``times`` is (id, time) in whole units; nodes without a time take none. Within
    a level, the targets in the order of their md5 are cut into stretches of about
    equal time, one for each worker; a level starts when the one before has
    ended. Running sums go over the first ``digits`` of the md5 and then within
    them, so neither a level nor the graph is ever in one task.
    """
    nodes = _ids(edges).join(levels(edges), "id", "left").join(times, "id", "full")
    rows = _kept(nodes.select("id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce(F.col("time"), F.lit(0)).cast("bigint").alias("time"), F.md5("id").alias("h")).withColumn("bucket", F.substring("h", 1, digits)))
    zero = F.lit(0).cast("bigint")
    sums = rows.groupBy("level", "bucket").agg(F.sum("time").alias("s"))
    at = Window.partitionBy("level").orderBy("bucket")
    sums = sums.select("level", "bucket", F.coalesce(F.sum("s").over(at.rowsBetween(Window.unboundedPreceding, -1)), zero).alias("before"), F.sum("s").over(Window.partitionBy("level")).alias("total"))
    within = Window.partitionBy("level", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.withColumn("inside", F.coalesce(F.sum("time").over(within), zero)).join(sums, ["level", "bucket"]).withColumn("cum", F.col("before") + F.col("inside"))
    cut = _kept(cut.select("id", "level", "time", "cum", F.when(F.col("total") == 0, 1).otherwise(F.least(F.lit(workers), F.expr(f"cum * {int(workers)} DIV total") + 1)).cast("int").alias("worker")))
    shares = cut.groupBy("level", "worker").agg(F.min("cum").alias("first"), F.sum("time").alias("busy"))
    length = shares.groupBy("level").agg(F.max("busy").alias("length"))  # one row a level
    began = length.select("level", F.coalesce(F.sum("length").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("began"))
    start = (F.col("began") + F.col("cum") - F.col("first")).cast("bigint")
    return cut.join(shares.join(began, "level"), ["level", "worker"]).select(F.col("id").alias("target"), "worker", start.alias("start"), (start + F.col("time")).alias("end"))
