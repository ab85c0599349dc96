"""The static grammar and the older plan algebra on tables of targets and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.branching import ordered_text


def map_grid(grid: DataFrame, call: str, args: list[str]) -> DataFrame:
    """(target, command): one call for each row of the grid."""
    target = F.concat_ws("_", F.lit(call), *[F.col(a).cast("string") for a in args])
    command = F.concat(F.lit(call + "("), F.concat_ws(", ", *[F.col(a).cast("string") for a in args]), F.lit(")"))
    return grid.select(target.alias("target"), command.alias("command"))


def cross_columns(grid: DataFrame, columns: list[str]) -> DataFrame:
    """All combinations of the distinct values of each column, nulls left out.

    The product is what the operator means: a row for each target of a plan, so
    as large as the plan, never as the data.
    """
    return reduce(lambda a, b: a.crossJoin(b), [grid.select(c).dropna().distinct() for c in columns])


def slice_columns(df: DataFrame, slices: int, index: int) -> DataFrame:
    """The index-th of so many contiguous slices of the columns; beyond them no column."""
    n = len(df.columns)
    size, extra = divmod(n, slices)
    start = (index - 1) * size + min(index - 1, extra)
    return df.select(*df.columns[start : start + size + (index <= extra)])


def combine_tagalong(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Groups with the columns that are complete and constant within them, else null."""
    kept = [F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).alias(c) for c in columns]
    return df.dropna(subset=by).groupBy(*by).agg(F.count("*").alias("n"), *kept)


def trace_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left outer join with one row of ``right`` for each complete key; no rows of ``left`` are added or lost.

    Of several rows with a key the least one, compared column by column, stays whole.
    """
    others = [c for c in right.columns if c not in keys]
    once = right.dropna(subset=keys).groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row"))
    return left.join(once.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in others]), keys, "left")


def evaluate_wildcard(plan: DataFrame, wildcard: str, values: DataFrame) -> DataFrame:
    """Each target whose command holds the wildcard, once for each value; others stay as they are."""
    hit = F.col("command").contains(wildcard)
    expanded = plan.where(hit).crossJoin(values).select(F.concat_ws("_", "target", "value").alias("target"), F.replace("command", F.lit(wildcard), F.col("value")).alias("command"))
    return expanded.unionByName(plan.where(~hit).select("target", "command"))


def gather_by(df: DataFrame, by: str, target: str, order: str, call: str, keep: Column | None = None) -> DataFrame:
    """One call for each group that names all its targets; a null filter counts as false."""
    rows = df if keep is None else df.where(F.coalesce(keep, F.lit(False)))
    item = F.concat(F.col(target), F.lit(" = "), F.col(target))
    text = F.concat(F.lit(call + "("), ordered_text(item, order, ", "), F.lit(")"))
    return rows.groupBy(by).agg(text.alias("command")).select(F.concat_ws("_", F.lit("gather"), F.col(by).cast("string")).alias("target"), "command")
