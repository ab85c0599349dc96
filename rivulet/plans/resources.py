"""Where a target's jobs run: their scheduler pool, and what executors and tasks they ask for."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession

POOL = "spark.scheduler.pool"
#: What a target's ``resources`` may hold.
KINDS = ("cores", "memory", "overhead", "pyspark_memory", "task_cpus")


@contextmanager
def in_pool(spark: SparkSession, pool: str | None) -> Iterator[None]:
    """Jobs that this thread starts go to the pool; afterwards to the one they went to before."""
    sc = spark.sparkContext
    before = sc.getLocalProperty(POOL)
    if pool is not None:
        sc.setLocalProperty(POOL, pool)
    try:
        yield
    finally:
        if pool is not None:
            sc.setLocalProperty(POOL, before)


def pool_of(spark: SparkSession, name: str, pool: str | None) -> str | None:
    """The pool that a target names; with fair scheduling each other target has its own, so that none waits for the whole of another."""
    fair = spark.sparkContext.getConf().get("spark.scheduler.mode", "FIFO").upper() == "FAIR"
    return pool or (name if fair else None)


def check(resources: dict[str, int | str]) -> None:
    if unknown := sorted(set(resources) - set(KINDS)):
        raise ValueError(f"unknown resources: {', '.join(unknown)}")


def profile(spark: SparkSession, resources: dict[str, int | str]) -> ResourceProfile | None:
    """The resource profile for what is asked for; a local session, which has no executors to ask for, gives none and warns."""
    check(resources)
    if not resources:
        return None
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        warnings.warn("a local session has no executors with resources of their own", stacklevel=2)
        return None
    executor, builder = ExecutorResourceRequests(), ResourceProfileBuilder()
    asks = {"cores": executor.cores, "memory": executor.memory, "overhead": executor.memoryOverhead, "pyspark_memory": executor.pysparkMemory}
    for kind, ask in asks.items():
        if kind in resources:
            ask(resources[kind])
    if any(kind in resources for kind in asks):
        builder = builder.require(executor)
    if "task_cpus" in resources:
        builder = builder.require(TaskResourceRequests().cpus(int(resources["task_cpus"])))
    return builder.build


def whole_groups(function: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``function`` over each group of rows that follow each other with equal keys, wherever batches end."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            number = batch[keys].ne(batch[keys].shift()).any(axis=1).cumsum()
            for _, rows in batch.groupby(number, sort=False):
                if held and tuple(held[0][keys].iloc[0]) != tuple(rows[keys].iloc[0]):
                    yield function(pd.concat(held, ignore_index=True))
                    held = []
                held.append(rows)
        if held:
            yield function(pd.concat(held, ignore_index=True))

    return each
