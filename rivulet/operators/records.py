"""Progress, history, build times, recovery and cached names, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the given unique order. max_by keeps this to one partial aggregation."""
    others = [c for c in log.columns if c != key]
    picked = log.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x"))
    return picked.select(key, *[F.col(f"x.`{c}`").alias(c) for c in others])


def with_progress(df: DataFrame, status: str, wanted: list[str] | None = None) -> DataFrame:
    return df.where(F.col(status).isin(wanted)) if wanted else df.where(F.col(status) != "none")


def history(log: DataFrame, meta: DataFrame, key: str, value: str) -> DataFrame:
    """Each entry of the log and whether it is what is stored now; no stored value means it is not."""
    now = meta.select(key, F.col(value).alias("_now"))
    out = log.join(now, key, "left")
    return out.withColumn("exists", F.col("_now").isNotNull()).withColumn("current", F.coalesce(F.col(value) == F.col("_now"), F.lit(False))).drop("_now")


def build_seconds(seconds: Column, digits: int = 3) -> Column:
    """A minute or more in whole seconds, less with so many digits."""
    return F.when(seconds >= 60, F.round(seconds, 0)).otherwise(F.round(seconds, digits)).cast(f"decimal(18,{digits})")


def unreferenced(objects: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Objects that no index entry names any more."""
    return objects.join(index, key, "left_anti")


def recoverable(wanted: DataFrame, log: DataFrame, key: str, *order: str) -> DataFrame:
    """For each wanted recovery key the latest stored result, if there is one."""
    return wanted.join(latest(log, key, *order), key)


# Selection of names, as columns of booleans.


def starts_with(name: Column, *prefixes: str) -> Column:
    return _any(name.startswith(p) for p in prefixes)


def ends_with(name: Column, *suffixes: str) -> Column:
    return _any(name.endswith(s) for s in suffixes)


def contains(name: Column, *parts: str) -> Column:
    return _any(name.contains(p) for p in parts)


def matches(name: Column, pattern: str) -> Column:
    return name.rlike(pattern)


def num_range(name: Column, prefix: str, numbers: range) -> Column:
    return name.isin([f"{prefix}{i}" for i in numbers])


def any_of(name: Column, names: list[str]) -> Column:
    return name.isin(names)


def all_of(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows with the given names; an error where one is missing."""
    found = {r[0] for r in df.where(F.col(column).isin(names)).select(column).distinct().collect()}
    if missing := sorted(set(names) - found):
        raise KeyError(f"no such names: {', '.join(missing)}")
    return df.where(F.col(column).isin(names))


def one_of(name: Column, *names: str) -> Column:
    """Any of the names."""
    return name.isin(list(names))


def everything(name: Column) -> Column:
    return F.lit(True) | name.isNull()


def last_col(df: DataFrame, column: str) -> DataFrame:
    """The row with the last name in alphabetical order."""
    return df.agg(F.max(column).alias(column))


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts)


def longest_match(name: Column, candidates: list[str]) -> Column:
    """The longest of the candidates that the name starts with, or null."""
    out = F.lit(None).cast("string")
    for c in sorted(candidates, key=len):
        out = F.when(name.startswith(c), F.lit(c)).otherwise(out)
    return out


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows, the same for the same seed however the rows are partitioned."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def seeded_draws(df: DataFrame, ordinal: str, seed: int, n: int) -> DataFrame:
    """n rows drawn with replacement; draw i takes the row whose ordinal a hash of seed and i gives."""
    size = df.count()
    number = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(size)) + 1
    draws = df.sparkSession.range(1, n + 1).select(F.col("id").alias("draw")).withColumn(ordinal, number)
    return draws.join(df, ordinal)


def last_ordinal(key: str) -> Column:
    return F.row_number().over(Window.orderBy(key)).cast("bigint")
