"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.words import ROWS_AT_ONCE, in_slices
from rivulet.sources.scratch import materialise, release, scratch_path, shared_dir

__all__ = ["materialise", "release", "scratch_path", "shared_dir", "map_batches", "table", "lookup", "only_ids", "without_ids"]

#: What separates words everywhere in this subpackage: the ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
NOT_SPACE_CLASS = r"[^\x20\x09-\x0D]"

#: Whole texts go to Python and back in batches of so many rows or bytes at most; the
#: defaults would hold up to 64 MB several times over in the executor and in Python.
ARROW_ROWS, ARROW_BYTES = 2048, 4 << 20


def map_batches(rows: DataFrame, function, schema, at_once: int | None = None) -> DataFrame:
    """``function`` over Arrow batches of ``rows``, in slices of ``at_once`` rows.

    Lowers the session's limits of a batch to ARROW_ROWS and ARROW_BYTES. They bound
    only what is in memory at once; every row is passed on.
    """
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return rows.mapInArrow(in_slices(function, at_once or ROWS_AT_ONCE), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: A key with more than one in so many rows is hot; there are fewer hot keys than this.
HOT = 1000


def lookup(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``values`` (a written table), joined by ``key``, without a hot task.

    ``values`` has one row for each key and, in ``n``, how many of the ``total`` rows
    hold it. Keys with more than total / HOT rows are fewer than HOT, so they
    are broadcast; no other key has more rows than that.
    """
    often = F.col("n") > total / HOT
    if values.where(often).isEmpty():
        return rows.join(values.drop("n"), key)
    hot, rest = F.broadcast(values.where(often).drop("n")), values.where(~often).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


#: Ids are hashed to so many slots before a broadcast, which bounds its size whatever their number.
SLOTS = 1 << 20


def _slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def _slots(ids: DataFrame, key: str) -> DataFrame:
    return F.broadcast(ids.select(_slot(key).alias("_rivulet_slot")).distinct())


def only_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids`` (one column of that name and type).

    Most other rows are left out by their slot before the join, so wide rows are
    not shuffled only to be dropped. With far more ids than slots nearly all
    rows pass the slots, and the join alone decides.
    """
    near = rows.join(_slots(ids, key), _slot(key) == F.col("_rivulet_slot"), "left_semi")
    return near.join(ids, key, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``ids``; rows whose slot holds no id are not shuffled."""
    slots = _slots(ids, key)
    at = _slot(key) == F.col("_rivulet_slot")
    near = rows.join(slots, at, "left_semi").join(ids, key, "left_anti")
    return rows.join(slots, at, "left_anti").unionByName(near.select(*[f"`{c}`" for c in rows.columns]))
