"""Hard negatives: rows of other labels that score below an anchor's positives, found with a table of distances to pivots.

Every vector x gets one more component, sqrt(M^2 - |x|^2), where M is the largest length of all.
Then all have length M, and the distance of an anchor (whose further component is
0) to a row is |anchor|^2 + M^2 - 2 score, squared: the nearest row scores highest. Each
row's distances to a few pivots are stored. By the triangle inequality its
distance to an anchor is at least the difference of their distances to any pivot and at most the
sum, which brackets its score. Only rows whose bracket
meets what is looked for are checked exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import scratch_path
from rivulet.llm.vector_blocks import BLOCK_ROWS, Block, best, first_of_each, integer_vectors, over_units, product, write_beside, write_blocks

#: Rows that pivots are chosen from, and pivots. They decide how many rows are checked exactly, not the result.
CHOICE, PIVOTS = 256, 12


class Pivots:
    """Pivots and the largest squared length of all rows."""

    def __init__(self, rows: np.ndarray, square: int, n: int = PIVOTS):
        """Picks pivots far from each other, the longest row first."""
        self.square = float(square)
        lengths = np.array([product(r[None], r[None])[0, 0] for r in rows], dtype=np.float64)
        further = np.sqrt(np.maximum(self.square - lengths, 0))
        near = 2 * self.square - 2 * (product(rows, rows) + further[:, None] * further[None, :])
        chosen = [int(lengths.argmax())] if len(rows) else []
        while 0 < len(chosen) < min(n, len(rows)):
            chosen.append(int(near[:, chosen].min(axis=1).argmax()))
        self.rows, self.further = rows[chosen], further[chosen]

    def table(self, rows: np.ndarray) -> np.ndarray:
        """Distances of rows, continued to length M, to the pivots."""
        further = np.sqrt(np.maximum(self.square - _squares(rows), 0))
        return np.sqrt(np.maximum(2 * self.square - 2 * (product(rows, self.rows) + further[:, None] * self.further[None, :]), 0))

    def anchors(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of anchors to the pivots, and |anchor|^2 + M^2."""
        both = _squares(rows) + self.square
        return np.sqrt(np.maximum(both[:, None] - 2 * product(rows, self.rows), 0)), both


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows.astype(np.float64), rows.astype(np.float64))


def brackets(anchor: np.ndarray, both: float, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of the rows of a pivot table, from below and above, wide enough for rounding."""
    least, most = np.abs(table - anchor).max(axis=1, initial=0), (table + anchor).min(axis=1, initial=np.inf)
    slack = 1 + 1e-9 * both
    return (both - most**2) / 2 - slack, (both - least**2) / 2 + slack


def _exact(anchor: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return product(anchor[None], rows[at])[0].astype(np.int64)


def _positives(k: int):
    """(row, anchor_id, vec_id, score): of each anchor the k best rows of its label in the block."""

    def search(anchors: Block, block: Block):
        found = [[], [], [], []]
        table, label = block.more["table"], block.more["label"]
        for i in range(len(anchors.ids)):
            at = np.flatnonzero((label == anchors.more["label"][i]) & (block.ids != anchors.ids[i]))
            if len(at) > k:
                low, high = brackets(anchors.more["anchor"][i], anchors.more["both"][i], table[at])
                at = at[high >= np.partition(low, -k)[-k]]
            if not len(at):
                continue
            score = _exact(anchors.vectors[i], block.vectors, at)
            keep = first_of_each(np.zeros(len(at), dtype=int), score, block.ids[at], k)
            for column, values in zip(found, (np.full(len(keep), anchors.rows[i]), np.full(len(keep), anchors.ids[i]), block.ids[at[keep]], score[keep]), strict=True):
                column.append(values)
        return [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in found]

    return search


def _negatives(k: int, low_share: int, high_share: int):
    """(row, positive_score, vec_id, score): for each positive's score the k best rows of other labels within its shares."""

    def search(anchors: Block, block: Block, positives: pd.DataFrame):
        found = [[], [], [], []]
        table, label = block.more["table"], block.more["label"]
        scores = {row: np.unique(group.to_numpy(np.int64)) for row, group in positives.groupby("row")["score"]}
        for i in range(len(anchors.ids)):
            goals = [(int(p), -(-low_share * int(p) // 100), high_share * int(p) // 100) for p in scores.get(anchors.rows[i], ())]
            goals = [g for g in goals if g[1] <= g[2]]
            if not goals:
                continue
            low, high = brackets(anchors.more["anchor"][i], anchors.more["both"][i], table)
            at = np.flatnonzero((label != anchors.more["label"][i]) & (high >= min(g[1] for g in goals)) & (low <= max(g[2] for g in goals)))
            score = _exact(anchors.vectors[i], block.vectors, at)
            for positive, least, most in goals:
                there = np.flatnonzero((score >= least) & (score <= most))
                keep = there[first_of_each(np.zeros(len(there), dtype=int), score[there], block.ids[at[there]], k)]
                for column, values in zip(found, (np.full(len(keep), anchors.rows[i]), np.full(len(keep), positive), block.ids[at[keep]], score[keep]), strict=True):
                    column.append(values)
        return [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in found]

    return search


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, shares: tuple[int, int] = (50, 95), pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and embedding; ``is_anchor`` is a condition over vec_id. A
    row's score is its inner product with the anchor, of components floor(256 * x); those beyond 2^24 count as 2^24. An anchor's
    positives are the rows of its label with the highest scores, and a positive's negatives
    those rows of other labels with the highest scores of ``shares[0]`` to ``shares[1]`` per cent of its own. With a
    negative positive score there are none, with 0 those of score 0. Ties go to the smaller vec_id.

    Rows with a null vec_id, label or vector, or with null or non-finite components, take
    no part. Of vectors of different lengths, very long and empty ones too, the shorter one counts as continued by zeros.
    Rows that are equal in vec_id, label and vector count once; rows of the anchor's own vec_id are not its positives.
    Other columns are left aside, whatever their names; an empty table gives an empty result.

    Labels are only compared within pairs of blocks, which are dealt by hash, so a label of any size makes no
    larger task. Pivots come from at most CHOICE rows; they decide the work, not the result.
    """
    rows = vectors.where("label IS NOT NULL").select("vec_id", "embedding", F.md5(F.col("label").cast("string")).alias("label"))
    rows = integer_vectors(rows, "label")
    length = F.expr("aggregate(vector, 0D, (a, x) -> a + CAST(x AS DOUBLE) * x)")
    square = rows.agg(F.max(length)).first()[0] or 0.0
    # a bounded choice, by hash: at most CHOICE rows come to the driver
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    some = rows.where(F.size("vector") == common[0]["dim"]).orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(CHOICE).collect() if common else []
    table = Pivots(np.array([r["vector"] for r in some], dtype=np.int32).reshape(len(some), common[0]["dim"] if common else 0), square, pivots)

    def row_columns(pdf: pd.DataFrame, matrix: np.ndarray) -> dict[str, np.ndarray]:
        return {"label": pdf["label"].to_numpy(str), "table": table.table(matrix)}

    def anchor_columns(pdf: pd.DataFrame, matrix: np.ndarray) -> dict[str, np.ndarray]:
        anchor, both = table.anchors(matrix)
        return {"label": pdf["label"].to_numpy(str), "anchor": anchor, "both": both}

    folder = scratch_path(vectors.sparkSession, "negatives")
    blocks = write_blocks(rows, folder, "rows", block_rows, row_columns)
    anchors = write_blocks(rows.where(is_anchor), folder, "anchors", block_rows, anchor_columns)
    found = over_units(anchors, blocks, folder, _positives(positives), "row long, anchor_id long, vec_id long, score long")
    chosen = best(found, ["row"], positives, "place").select("row", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place")
    beside = write_beside(chosen.select("row", F.col("positive_score").alias("score")), folder, "positives")
    found = over_units(anchors.join(beside, "block"), blocks, folder, _negatives(negatives, *shares), "row long, positive_score long, vec_id long, score long")
    ranked = best(found, ["row", "positive_score"], negatives, "rank")
    return ranked.join(chosen, ["row", "positive_score"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
