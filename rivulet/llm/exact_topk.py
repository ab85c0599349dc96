"""Exact top-k by inner product: the three-phase uniform threshold over lists of partial scores.

The components are cut into lists. What a vector adds to a query's score in one
list is its entry there, and its score is the sum of its entries.

1. Each list of each block gives its k highest entries, whose scores are summed up on the spot,
   and its lowest entry. The k-th best of these scores is one that the
   answer surely reaches.
2. A vector that reaches it must lie above the lowest entry, in at least one list, by the same share
   of what is missing: the uniform threshold. It is sent out with the queries, and
   each list collects its entries from there on. What was collected bounds
   a vector's score from above; those that cannot reach the k-th best any more go.
3. The others' scores are summed up exactly; the k best of each block, and of these, remain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import scratch_path
from rivulet.llm.vector_blocks import BLOCK_ROWS, Block, best, first_of_each, integer_vectors, over_units, product, write_beside, write_blocks

#: Queries whose scores with a block are held at once.
AT_ONCE = 64
#: More lists are shorter ones: their thresholds say less about the sum.
LISTS = 2
#: Lower than all scores: there are fewer than k other vectors, and all are in the answer.
NO_SCORE = -(1 << 62)


def _entries(queries: np.ndarray, rows: np.ndarray, lists: int) -> list[np.ndarray]:
    dim = min(queries.shape[1], rows.shape[1])
    cuts = [dim * j // lists for j in range(lists + 1)]
    found = [product(queries[:, a:b], rows[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return found if len({x.dtype for x in found}) == 1 else [x.astype(np.int64) for x in found]


def _gather(k: int, lists: int):
    """Phase 1: (row, list, vec_id, score): a query's candidates with list -1, and the lowest entry of each list."""

    def gather(queries: Block, block: Block):
        found = [[], [], [], []]
        for at in range(0, len(queries.ids), AT_ONCE):
            rows, ids = queries.rows[at : at + AT_ONCE], queries.ids[at : at + AT_ONCE]
            entries = _entries(queries.vectors[at : at + AT_ONCE], block.vectors, lists)
            score = sum(entries)
            own = ids[:, None] == block.ids[None, :]
            chosen = np.zeros(score.shape, dtype=bool)
            for j, entry in enumerate(entries):
                open_ = np.where(own, NO_SCORE, entry)
                top = np.argpartition(open_, -k, axis=1)[:, -k:] if open_.shape[1] > k else np.broadcast_to(np.arange(open_.shape[1]), open_.shape)
                np.put_along_axis(chosen, top, True, axis=1)
                for column, values in zip(found, (rows, np.full(len(rows), j), np.zeros(len(rows)), entry.min(axis=1)), strict=True):
                    column.append(values.astype(np.int64))
            q, b = np.nonzero(chosen & ~own)
            keep = first_of_each(q, score[q, b], block.ids[b], k)
            q, b = q[keep], b[keep]
            for column, values in zip(found, (rows[q], np.full(len(q), -1), block.ids[b], score[q, b]), strict=True):
                column.append(values.astype(np.int64))
        return [np.concatenate(c) for c in found]

    return gather


def _resolve(k: int, lists: int):
    """Phases 2 and 3: (row, query_id, vec_id, score), the k best of the block that reach what the answer surely reaches."""

    def resolve(queries: Block, block: Block, cutoffs: pd.DataFrame):
        found = [[], [], [], []]
        cutoffs = cutoffs.set_index("row").reindex(queries.rows)
        reached, lowest = cutoffs["reached"].to_numpy(np.int64), np.array(cutoffs["lowest"].tolist(), dtype=np.int64)
        for at in range(0, len(queries.ids), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            rows, ids = queries.rows[part], queries.ids[part]
            entries = _entries(queries.vectors[part], block.vectors, lists)
            low, goal = lowest[part], reached[part]
            missing = np.where(goal == NO_SCORE, 0, goal - low.sum(axis=1))  # over the lowest entries, in all lists together
            collected, bound = np.zeros(entries[0].shape, dtype=bool), np.zeros_like(entries[0])
            for j, entry in enumerate(entries):
                there = lists * (entry - low[:, j, None]) >= missing[:, None]
                collected |= there
                bound += np.where(there, entry, low[:, j, None] + (missing // lists + 1)[:, None])
            remaining = collected & (bound >= goal[:, None]) & (ids[:, None] != block.ids[None, :])
            q, b = np.nonzero(remaining)
            score = sum(entry[q, b] for entry in entries)
            keep = first_of_each(q, score, block.ids[b], k)
            q, b = q[keep], b[keep]
            for column, values in zip(found, (rows[q], ids[q], block.ids[b], score[keep]), strict=True):
                column.append(values.astype(np.int64))
        return [np.concatenate(c) for c in found]

    return resolve


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, lists: int = LISTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the highest integer inner products with each query.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition over vec_id.
    Components x count as floor(256 * x), beyond 2^24 as 2^24. Rows whose vec_id or vector is null, or
    whose vector holds null or non-finite components, take no part, not as queries either; all others are
    candidates, zero, empty and very long vectors too. Of vectors of different lengths the shorter
    one counts as continued by zeros. Ties go to the smaller vec_id. Rows that are equal in vec_id and
    vector count once; rows of the query's own vec_id are no candidates; a vec_id with unlike vectors is as
    many rows. Fewer than k candidates are all returned. Other columns
    are left aside, whatever their names; an empty table gives an empty result.

    Work is queries times rows, in pairs of blocks, twice. What leaves a pair is k
    rows for each query and a number for each list. Cutoffs are written beside the queries, one file for each block of them.
    """
    if k < 1 or lists < 1:
        raise ValueError("k and lists must be positive")
    rows = integer_vectors(vectors.select("vec_id", "embedding"))
    folder = scratch_path(vectors.sparkSession, "topk")
    blocks, queries = write_blocks(rows, folder, "rows", block_rows), write_blocks(rows.where(is_query), folder, "queries", block_rows)
    gathered = over_units(queries, blocks, folder, _gather(k, lists), "row long, list int, vec_id long, score long")
    surely = best(gathered.where("list < 0"), ["row"], k, "rank").where(F.col("rank") == k).select("row", F.col("score").alias("reached"))
    lowest = gathered.where("list >= 0").groupBy("row").agg(*[F.min(F.when(F.col("list") == j, F.col("score"))).alias(f"_{j}") for j in range(lists)])
    cutoffs = lowest.join(surely, "row", "left").select("row", F.coalesce("reached", F.lit(NO_SCORE)).alias("reached"), F.array(*[f"_{j}" for j in range(lists)]).alias("lowest"))
    queries = queries.join(write_beside(cutoffs, folder, "cutoffs"), "block")
    resolved = over_units(queries, blocks, folder, _resolve(k, lists), "row long, query_id long, vec_id long, score long")
    return best(resolved, ["row"], k, "rank").select("query_id", "rank", "vec_id", "score")
