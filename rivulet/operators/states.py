"""Triggers and statuses as columns over old and new metadata, joined side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(old: Column, new: Column) -> Column:
    """Whether two values differ; null differs from every value but null."""
    return ~old.eqNullSafe(new)


def format_changed(old: Column, new: Column) -> Column:
    """Only two known formats can differ."""
    return F.coalesce(old != new, F.lit(False))


def decide(condition: Column, others: Column, mode: str = "whitelist") -> Column:
    """The condition trigger's modes: it can force, forbid, or be all that counts."""
    condition = F.coalesce(condition, F.lit(False))
    if mode == "whitelist":
        return condition | others
    if mode == "blacklist":
        return condition & others
    if mode == "condition":
        return condition
    raise ValueError(f"unknown trigger mode: {mode}")


def dependency_hash(deps: DataFrame, target: str = "target", value: str = "hash") -> DataFrame:
    """(target, dependency_hash): md5 of the sorted distinct hashes of what a target depends on."""
    return deps.groupBy(target).agg(F.md5(F.array_join(F.array_sort(F.collect_set(value)), "")).alias("dependency_hash"))


def dependency_profile(old: DataFrame, new: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, name, changed, old, new): the fingerprints of both sides, one row for each."""
    both = old.select(key, *[F.col(n).alias(f"old_{n}") for n in names]).join(new.select(key, *[F.col(n).alias(f"new_{n}") for n in names]), key)
    triples = ", ".join(f"'{n}', old_{n}, new_{n}" for n in names)
    out = both.select(key, F.expr(f"stack({len(names)}, {triples}) AS (name, old, new)"))
    return out.withColumn("changed", changed(F.col("old"), F.col("new")))


def node_status(imported: Column, missing: Column, outdated: Column, failed: Column, running: Column | None = None, cancelled: Column | None = None) -> Column:
    """The last of imported, up to date, missing, outdated, running, cancelled, failed that holds."""
    status = F.when(failed, "failed")
    if cancelled is not None:
        status = status.when(cancelled, "cancelled")
    if running is not None:
        status = status.when(running, "running")
    return status.when(outdated, "outdated").when(missing, "missing").when(imported, "imported").otherwise("up to date")


def node_type(dynamic: Column, file: Column, function: Column) -> Column:
    return F.when(function, "function").when(file, "file").when(dynamic, "dynamic").otherwise("object")
