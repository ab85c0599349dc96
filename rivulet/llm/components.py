"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import lookup, map_batches, materialise


#: Links that one task joins at most: some 50 MB in Python.
IN_ONE_TASK = 1 << 18


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while parent.setdefault(root, root) != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) that join the same nodes as the links (a, b)."""
    parent: dict[int, int] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if _find(parent, x) != x]
    return np.array(nodes, dtype=np.int64), np.array([_find(parent, x) for x in nodes], dtype=np.int64)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of links as a forest."""
    for batch in batches:
        u, v = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _forests(edges: DataFrame) -> DataFrame:
    """Links that join the same nodes, contracted batch by batch."""
    return materialise(map_batches(edges, _contracted, "u long, v long", 1 << 15).distinct(), "links")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of a task as one forest."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.empty(0, dtype=np.int64),) * 2
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _are_stars(edges: DataFrame) -> bool:
    """Whether every link leads from a node with no other link to the smallest node of its component."""
    several = edges.groupBy("u").agg(F.count("*").alias("k")).where("k > 1").select("u")
    between = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return several.unionByName(between).isEmpty()


def components(links: DataFrame, max_rounds: int = 40, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(id, component) of every node that has a link, by alternating large and small stars.

    ``links`` has two columns of whole numbers. Links of a node with itself and
    links with nulls join nothing. The component is its smallest id. Batches
    of links are contracted first and after each round, which points all larger neighbours
    of a node to the smallest one, and all smaller neighbours likewise, until
    only stars are left. A round's links are written to the shared folder. The root of a
    giant component is in a link with all its nodes, so such nodes are joined by broadcast. Once at most
    ``in_one_task`` links are left, one task joins them; that bounds its memory and changes no component.
    """
    a, b = links.columns
    edges = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v")
    edges = _forests(edges)
    for _ in range(max_rounds):
        n = 2 * edges.count()
        if n <= 2 * in_one_task:
            edges = materialise(edges.coalesce(1).mapInArrow(_solved, "u long, v long"), "links")
            break
        if _are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = materialise(lookup(both, least, "u", n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lower")
        both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = lookup(large, lower, "u", n).select(F.explode(F.when(F.col("v") == F.col("m"), F.slice(both, 2, 1)).otherwise(both)).alias("e"))
        edges = _forests(small.select("e.u", "e.v").where("u <> v"))
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
