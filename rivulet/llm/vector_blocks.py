"""Blocks of integer vectors in the shared folder, and the units of work that compare a block of queries with one of rows.

Each distinct vector is in one block, a file that an executor writes. A unit of
work is a pair of a query block and a row block; it reads two files and holds
nothing else. Units have numbers and are dealt by them, so tasks get equal shares.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import lookup, map_batches, materialise
from rivulet.llm.shared_files import read_file, write_file
from rivulet.llm.words import give_back

#: A component stops at so much, which keeps the scores of vectors of up to 2^15 components within 64 bits.
LARGEST = 1 << 24
#: Vectors in a block, and bytes at most.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
#: Tasks that the units of work are dealt to at most.
MOST_TASKS = 20_000


def integer_vectors(rows: DataFrame, *keep: str, scale: int = 256) -> DataFrame:
    """Distinct (vec_id, keep..., vector) of the rows that take part; components x become floor(scale * x), x taken as a double.

    Rows whose vec_id or vector is null, or whose vector holds null or non-finite
    components, take no part. Rows that are equal in all of these count once.
    """
    usable = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    whole = f"transform(embedding, x -> CAST(floor(least(greatest({scale} * x, -{LARGEST}D), {LARGEST}D)) AS INT))"
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>")).where(F.coalesce(F.expr(usable), F.lit(False)))
    return materialise(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), *keep, F.expr(whole).alias("vector")).distinct(), "vectors")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact; the longer one's further components meet zeros."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim
    if largest < 2**53:  # every sum is a whole number that a double holds
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(np.int64) @ b.astype(np.int64).T


class Block:
    """Vectors sorted by vec_id; ``number`` tells each from all others of its kind."""

    def __init__(self, number: int, ids: np.ndarray, vectors: np.ndarray, **more: np.ndarray):
        self.ids, self.vectors, self.more = ids, vectors, more
        self.rows = np.arange(len(ids), dtype=np.int64) + (number << 15)


def write_blocks(vectors: DataFrame, folder: str, kind: str, block_rows: int = BLOCK_ROWS, more: Callable[[pd.DataFrame, np.ndarray], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """(block, path) of files of at most about ``block_rows`` vectors of one length, dealt by hash.

    ``more`` gives further arrays of a block from its rows and its matrix.
    """
    rows = vectors.withColumn("dim", F.size("vector"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"))
    fit = F.least(F.lit(min(block_rows, 1 << 15)), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest("dim", F.lit(1))))))
    sizes = materialise(sizes.withColumn("parts", F.ceil(F.col("n") / fit).cast("bigint")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    dealt = lookup(rows, sizes, "dim", total).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts"))).drop("parts")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable", ignore_index=True)
        dim, part = int(pdf["dim"][0]), int(pdf["part"][0])
        number = (dim << 27) | part
        matrix = np.array(pdf["vector"].tolist(), dtype=np.int32).reshape(len(pdf), dim)
        block = Block(number, pdf["vec_id"].to_numpy(np.int64), matrix, **(more(pdf, matrix) if more else {}))
        path = write_file(folder, f"{kind}-{number}.block", pickle.dumps(block, protocol=5))
        give_back()
        return pd.DataFrame([(number, path)], columns=["block", "path"])

    return materialise(dealt.groupBy("dim", "part").applyInPandas(pack, "block long, path string"), "block-paths")


def write_beside(rows: DataFrame, folder: str, kind: str) -> DataFrame:
    """(block, beside): a file for each query block with its part of ``rows``, whose column ``row`` is a query's number."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["block"].iloc[0])
        path = write_file(folder, f"{kind}-{number}.beside", pickle.dumps(pdf.drop(columns="block"), protocol=5))
        return pd.DataFrame([(number, path)], columns=["block", "beside"])

    by_block = rows.withColumn("block", F.shiftright("row", 15))  # a block is bounded in rows, and so is what belongs to it
    return materialise(by_block.groupBy("block").applyInPandas(pack, "block long, beside string"), "beside-paths")


def over_units(queries: DataFrame, rows: DataFrame, folder: str, search: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows of ``search(query block, row block, what is beside the query block)`` for each pair of blocks.

    ``queries`` has (block, path) and perhaps ``beside``; a query block that is to be left out is not in it.
    """
    spark, has_more = queries.sparkSession, "beside" in queries.columns
    nq, nr = queries.count(), rows.count()

    def numbered(paths: DataFrame, name: str) -> DataFrame:  # one row for each block
        return paths.withColumn(name, F.row_number().over(Window.orderBy("block")).cast("bigint") - 1).drop("block")

    pairs = spark.range(nq * nr).select(F.col("id").alias("unit"), F.expr(f"id div {max(nr, 1)}").alias("q"), F.expr(f"id % {max(nr, 1)}").alias("r"))
    pairs = pairs.join(numbered(queries, "q").withColumnRenamed("path", "query_path"), "q").join(numbered(rows, "r").withColumnRenamed("path", "row_path"), "r")
    pairs = materialise(pairs.select("unit", "query_path", "row_path", *(["beside"] if has_more else [])), "units")
    names = [f.strip().rpartition(" ")[0] for f in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    types = [kinds[f.strip().rpartition(" ")[2]] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}

        def load(kind: str, path: str):
            if held.get(kind, ("",))[0] != path:
                held[kind] = (path, pickle.loads(read_file(folder, path)))
            return held[kind][1]

        for batch in batches:
            for row in batch.to_pylist():
                more = [load("beside", row["beside"])] if has_more else []
                columns = search(load("query", row["query_path"]), load("row", row["row_path"]), *more)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    pairs = pairs.repartitionByRange(max(1, min(nq * nr, MOST_TASKS)), "unit")
    return materialise(map_batches(pairs, run, schema, 64), "found")


def best(rows: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    """The k highest scores of each group, ties to the smaller vec_id, numbered from 1 as ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each group, ties to the smaller id."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, dtype=int)
    place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    return order[place < k]


def divisible(by: int) -> Column:
    return F.col("vec_id") % by == 0
