"""Embedding near-duplicates: one small-world graph per shard, queried by every vector.

Only vectors of the same label and length are compared, by cosine in double
precision. Exact copies are folded first, so the graphs hold each distinct
vector once. A label's vectors are dealt by hash to shards, each with its own
graph, and to blocks of queries, both bounded in rows and bytes and written to the
shared folder; each (block, shard) pair is one unit of work, dealt evenly whatever its
label, and reads its two files. A search widens its beam until the beam ends
below the threshold, in the end to all of the shard, so no vector has a cap on
its partners, and until an audit of sampled queries against all of the shard
finds enough of their links. Links are counted and joined a few queries at a
time and never held together.
"""

from __future__ import annotations

import logging
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import lookup, map_batches, materialise, scratch_path
from rivulet.llm.components import components
from rivulet.llm.hnsw import Hnsw
from rivulet.llm.shared_files import read_file, write_file
from rivulet.llm.words import give_back

LOG = logging.getLogger("rivulet.llm")
#: Distinct vectors in a shard and in a block of queries, their bytes at most, and the fewest shards of a label.
SHARD_ROWS, BLOCK_ROWS, SHARD_BYTES, MIN_SHARDS = 20_000, 20_000, 16 << 20, 2
AUDITED, AUDIT_RECALL, FIRST_BEAM, MARGIN = 48, 0.995, 32, 0.05
#: Queries whose links are held at once; beams wider than a shard's rows over this become a scan of the shard.
STEP, SCAN = 64, 16
#: Tasks that the units of work are dealt to at most.
MOST_TASKS = 20_000


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _pack(folder: str, build: bool):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        first = pdf.iloc[0]
        label, dim, part = first["label"], int(first["dim"]), int(first["part"])
        unit = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]]))
        content = {"ids": pdf["node"].to_numpy(np.int64), "copies": pdf["copies"].to_numpy(np.int64), "vectors": unit, "graph": Hnsw(unit).dumps() if build else None}
        # a label can hold any characters, so its bytes name the file
        path = write_file(folder, f"{label.encode().hex()[:100]}-{int(first['labelled'])}-{dim}-{part}.{'graph' if build else 'block'}", pickle.dumps(content, protocol=5))
        del content, unit
        give_back()
        return pd.DataFrame([(label, dim, part, path)], columns=["label", "dim", "part", "path"])

    return packed


class _Links:
    """How many links each query has, and what the links join; ``at`` are the nodes' numbers."""

    def __init__(self, query_at: np.ndarray, base_at: np.ndarray, copies: np.ndarray):
        self.query_at, self.base_at, self.copies = query_at, base_at, copies
        self.n = np.zeros(len(query_at), dtype=np.int64)
        self.root = np.arange(max(query_at.max(initial=-1), base_at.max(initial=-1)) + 1)

    def add(self, query: int, base: np.ndarray) -> None:
        nodes = self.base_at[base]
        others = nodes != self.query_at[query]
        self.n[query] = self.copies[base[others]].sum()
        roots = self.root[nodes]
        own = self.root[self.query_at[query]]
        if (roots != own).any():
            every = np.unique(np.append(roots, own))
            self.root[np.isin(self.root, every)] = every[0]


def search_block(graph: Hnsw, base: np.ndarray, queries: np.ndarray, threshold: float, add) -> tuple[int, int]:
    """Calls ``add(query, base rows)`` once for each query, with all rows found at a cosine of at least the threshold.

    ``base`` and ``queries`` are unit vectors in double precision. Returns the
    audit: links of sampled queries that were found, and those that there are.
    """
    n, sampled = len(base), np.unique(np.linspace(0, len(queries) - 1, AUDITED).astype(int))
    truth = {int(i): np.flatnonzero(base @ queries[i] >= threshold) for i in sampled}

    def found(todo: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of each query, with a beam as wide as it needs."""
        while len(todo):
            if width * SCAN > n:  # as wide as the shard
                for at in range(0, len(todo), STEP):
                    near = queries[todo[at : at + STEP]] @ base.T >= threshold
                    yield from ((int(q), np.flatnonzero(row)) for q, row in zip(todo[at : at + STEP], near, strict=True))
                return
            wider = []
            for at in range(0, len(todo), 1024):
                part = todo[at : at + 1024]
                sims, nodes = graph.search(queries[part].astype(np.float32), width)
                near = (nodes >= 0) & (sims >= threshold - 1e-3)
                full = near[:, -1] | (sims[:, -1] >= threshold - MARGIN)  # there may be more
                wider.append(part[full])
                for q, row, at_near in zip(part[~full].tolist(), nodes[~full], near[~full], strict=True):
                    rows = row[at_near]
                    yield q, rows[base[rows] @ queries[q] >= threshold]
            todo, width = np.concatenate(wider), 2 * width

    beam = FIRST_BEAM
    while True:  # first the sampled queries alone, to find the beam that the others start with
        hit = sum(len(np.intersect1d(truth[q], rows)) for q, rows in found(sampled, beam))
        want = sum(map(len, truth.values()))
        if hit >= AUDIT_RECALL * want or beam * SCAN > n:
            break
        beam *= 2
    for q, rows in found(np.arange(len(queries)), beam):
        add(q, rows)
    return hit, want


def _searcher(folder: str, threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, block = (pickle.loads(read_file(folder, row[k])) for k in ("shard", "block"))
                ids = np.unique(np.append(shard["ids"], block["ids"]))
                links = _Links(np.searchsorted(ids, block["ids"]), np.searchsorted(ids, shard["ids"]), shard["copies"])
                hit, want = search_block(Hnsw.loads(shard["graph"]), shard["vectors"], block["vectors"], threshold, links.add)
                counted, joined = np.flatnonzero(links.n), np.flatnonzero(links.root != np.arange(len(ids)))
                a = np.concatenate([block["ids"][counted], ids[joined], [hit]])
                b = np.concatenate([block["ids"][counted], ids[links.root[joined]], [want]])
                n = np.concatenate([links.n[counted], np.zeros(len(joined), dtype=np.int64), [-1]])
                del shard, block, links
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return search


def _one_id(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """Ties (a, b) of the nodes of each vec_id that names unlike vectors; they join components and are no links."""
    keys = rows.where("key IS NOT NULL").select("vec_id", "key", F.xxhash64("key").alias("h"))
    several = keys.groupBy("vec_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("vec_id")
    nodes = keys.join(several, "vec_id", "left_semi").select("vec_id", "key").distinct().join(distinct.select("key", "node"), "key")
    nodes = materialise(nodes.select("vec_id", "node"), "nodes-of-ids")
    first = materialise(nodes.groupBy("vec_id").agg(F.min("node").alias("b"), F.count("*").alias("n")), "first-nodes")
    return lookup(nodes, first, "vec_id", max(nodes.count(), 1)).select(F.col("node").alias("a"), "b").where("a <> b")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, audit: list | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors that are null, all zero, or hold null or non-finite components, and
    those without a label, link with nothing and are their own components.
    So are vectors of different lengths to each other; a vector of any length counts
    whole. Copies of a vector link with each other (their cosine is 1) and with the
    same others. n_links counts rows; a vec_id that occurs twice has two rows, each with the links of its
    own vector, in one component. ``audit`` gets a pair: how many links of sampled vectors the
    search found, and how many there are by comparison with all of the shard. Other columns are left aside; an empty table gives none.
    """
    single = dict(vectors.dtypes)["embedding"] == "array<float>"  # half the bytes; all sums are made in double precision
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector"))
    usable = F.expr("label IS NOT NULL AND vec_id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND x = x AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)")
    key = F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit(1), F.reverse("vector")), F.size("vector"), "label")
    rows = rows.select("vec_id", "label", "vector", F.when(F.coalesce(usable, F.lit(False)), key).alias("key"))
    distinct = rows.where("key IS NOT NULL").groupBy("key", "label").agg(F.min(F.struct("vec_id", "vector")).alias("x"), F.count("*").alias("n"))
    # a vec_id may name several vectors, so nodes have numbers of their own, fixed once written
    distinct = distinct.select("key", "label", F.col("x.vec_id").alias("rep"), "x.vector", F.col("n").alias("copies"), F.size("x.vector").alias("dim"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("fit", F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    sizes = sizes.withColumn("labelled", F.xxhash64("label"))
    group = distinct.select("node", "copies", "vector", F.concat_ws(":", "dim", "label").alias("group"))
    groups = sizes.select(F.concat_ws(":", "dim", "label").alias("group"), "n", "label", "dim", "fit", "labelled", F.col("n").alias("many"))
    groups = materialise(groups, "groups")
    dealt = lookup(group, groups, "group", distinct.count()).drop("group")
    shard = F.pmod(F.xxhash64("node"), F.greatest(F.ceil(F.col("many") / F.least(F.lit(shard_rows), "fit")), F.lit(MIN_SHARDS)).cast("bigint"))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("many") / F.least(F.lit(block_rows), "fit")).cast("bigint"))
    columns, packed, folder = ["label", "labelled", "dim", "part", "node", "copies", "vector"], "label string, dim int, part long, path string", scratch_path(vectors.sparkSession, "graphs")

    def files(part: F.Column, build: bool) -> DataFrame:
        grouped = dealt.withColumn("part", part).select(*columns).groupBy("label", "dim", "part").applyInPandas(_pack(folder, build), packed)
        return materialise(grouped, "graph-paths" if build else "block-paths")

    shards, blocks = files(shard, True), files(block, False)
    # one row for each unit of work: two paths, nothing else
    pairs = shards.withColumnRenamed("path", "shard").join(blocks.select("label", "dim", F.col("path").alias("block")), ["label", "dim"])
    pairs = materialise(pairs.select("shard", "block").withColumn("unit", F.monotonically_increasing_id()), "units")
    # by ranges of a number, so that small rows are not packed into few tasks
    pairs = pairs.repartitionByRange(max(1, min(pairs.count(), MOST_TASKS)), "unit").select("shard", "block")
    found = materialise(map_batches(pairs, _searcher(folder, threshold), "a long, b long, n long", 1), "vector-links")
    hit, want = found.where("n = -1").agg(F.sum("a"), F.sum("b")).first()
    LOG.info("audit: %s of %s links of sampled vectors found", hit or 0, want or 0)
    if audit is not None:
        audit.append((hit or 0, want or 0))
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    state = components(found.where("n = 0").select("a", "b").unionByName(_one_id(rows, distinct)))
    joined = distinct.select("node", "key", "rep", "copies").join(state.select(F.col("id").alias("node"), "component"), "node", "left").join(counts, "node", "left")
    joined = materialise(joined.withColumn("component", F.coalesce("component", "node")), "joined-vectors")
    least = materialise(joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "components")
    state = lookup(joined, least, "component", joined.count())
    state = materialise(state.select("key", F.col("copies").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-states")
    linked = lookup(rows.where("key IS NOT NULL").select("vec_id", "key"), state, "key", vectors.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
