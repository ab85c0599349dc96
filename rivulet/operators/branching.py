"""Dynamic branching: branches are rows with a number, never jobs of their own.

``_ord`` is a row's position in its input, ``_branch`` the 1-based number of its
branch, ``_branch_key`` the value or content that names the branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ORDERED_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "decimal")


def _bounds(df: DataFrame, key: Column, n: int) -> list:
    """At most n - 1 values of ``key`` that cut the rows into ranges of about one size, from a few thousand rows."""
    rows = df.select(key.alias("k")).where("k IS NOT NULL").orderBy(F.rand(7)).limit(4096).collect()
    found = sorted(r["k"] for r in rows)
    return sorted({found[i * len(found) // n] for i in range(1, n)}) if found else []


def with_ordinal(df: DataFrame, *order: str, out: str = "_ord", ranges: int | None = None) -> DataFrame:
    """Adds each row's 1-based position in the given order, which must be unique.

    Approximate quantiles of the first column (for strings: of a sample of 4,096
    rows) cut the rows into ranges; rows are numbered within their range and
    shifted by the sizes of the ranges before. No task sees more than one range,
    and only rows with the same first value share one whatever their number. Rows
    whose first column is null come first. A first column of another type is
    numbered in one task and is meant for small tables.
    """
    kind = dict(df.dtypes)[order[0]].split("(")[0]
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(f"`{order[0]}`")
    if kind == "string":
        bounds = _bounds(df, key, n) if n > 1 else []
    elif kind in _ORDERED_TYPES:
        if kind.startswith("timestamp") or kind == "date":
            key = F.unix_micros(key.cast("timestamp"))
        key = key.cast("double")
        bounds = df.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else []
        bounds = sorted(set(bounds or []))
    else:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)) if bounds else F.lit(0)
    cut = df.withColumn("_range", F.when(key.isNull(), F.lit(-1)).otherwise(part))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    numbered = cut.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    numbered = numbered.join(F.broadcast(before), "_range")  # at most ``ranges`` + 1 rows
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_shift") + F.col("_k")).cast("bigint").alias(out))


def map_rows(df: DataFrame, *order: str, **commands: Column) -> DataFrame:
    """One branch for each row, in order; ``commands`` are the columns it computes."""
    return with_ordinal(df, *order, out="_branch").select("_branch", *[c.alias(n) for n, c in commands.items()])


def zip_map(left: DataFrame, right: DataFrame, left_order: str, right_order: str, check: bool = True) -> DataFrame:
    """Branch i sees row i of both inputs, which must have as many rows."""
    if check and (n := left.count()) != (m := right.count()):
        raise ValueError(f"cannot map over inputs of {n} and {m} rows")
    return with_ordinal(left, left_order, out="_branch").join(with_ordinal(right, right_order, out="_branch"), "_branch")


def cross(left: DataFrame, right: DataFrame, left_order: str, right_order: str, first_slowest: bool = True) -> DataFrame:
    """All combinations, numbered with the first input varying slowest (or fastest).

    A Cartesian product is what the operator means; its inputs are the values to
    branch over, not data. Its size is the number of branches asked for.
    """
    a, b = with_ordinal(left, left_order, out="_i"), with_ordinal(right, right_order, out="_j")
    n = (right if first_slowest else left).count()
    number = (F.col("_i") - 1) * n + F.col("_j") if first_slowest else (F.col("_j") - 1) * n + F.col("_i")
    return a.crossJoin(b).withColumn("_branch", number.cast("bigint")).drop("_i", "_j")


def group_numbers(df: DataFrame, by: str | list[str], order: str, out: str = "_branch", null_group: str = "keep") -> DataFrame:
    """(by..., _branch): groups numbered by the first appearance of their key.

    Only the first ordinal of each group is sorted, not the rows. A null key is a
    group; ``null_group="empty"`` leaves its rows out.
    """
    by = [by] if isinstance(by, str) else by
    rows = df.dropna(subset=by) if null_group == "empty" else df
    first = rows.groupBy(*by).agg(F.min(order).alias("_first"))
    return with_ordinal(first, "_first", out=out).drop("_first")


def group_by(df: DataFrame, by: str, order: str, **aggregates: Column) -> DataFrame:
    """One branch for each key in order of first appearance, with its aggregates, in a single aggregation."""
    grouped = df.groupBy(by).agg(F.min(order).alias("_first"), *[c.alias(n) for n, c in aggregates.items()])
    return with_ordinal(grouped, "_first", out="_branch").drop("_first")


def group_all(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Without a key there is one branch of all rows."""
    return df.agg(*[c.alias(n) for n, c in aggregates.items()]).withColumn("_branch", F.lit(1).cast("bigint"))


def ordered_text(value: str | Column, order: str, sep: str = ",") -> Column:
    """Values of a group in order, as text; ordered by itself, because collect_list is not."""
    value = F.col(value) if isinstance(value, str) else value
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.cast("string").alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)


def max_expand(df: DataFrame, k: int, branch: str = "_branch") -> DataFrame:
    """The first k branches."""
    return df.where(F.col(branch) <= k)


def spaced_ordinals(n: int, k: int) -> list[int]:
    """k evenly spaced numbers of 1..n, first and last among them."""
    if k >= n:
        return list(range(1, n + 1))
    if k <= 1:
        return [1][:k]
    return sorted({1 + (i * (n - 1)) // (k - 1) for i in range(k)})


def max_expand_spaced(df: DataFrame, k: int, branch: str = "_branch") -> DataFrame:
    """k evenly spaced branches."""
    return df.where(F.col(branch).isin(spaced_ordinals(df.count(), k)))


def slice_number(n: int, slices: int, ordinal: str = "_ord") -> Column:
    """Which of ``slices`` contiguous, near-equal slices a position falls in; the first n mod slices have one more."""
    size, extra = divmod(n, slices)
    o = F.col(ordinal)
    if size == 0:
        return o
    long = extra * (size + 1)
    return F.when(o <= long, F.ceil(o / (size + 1))).otherwise(extra + F.ceil((o - long) / size)).cast("bigint")


def split(df: DataFrame, slices: int, *order: str) -> DataFrame:
    """Rows with ``_slice``; arithmetic on positions instead of a global ntile."""
    return with_ordinal(df, *order).withColumn("_slice", slice_number(df.count(), slices)).drop("_ord")


def bind(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def branch_keys(df: DataFrame, key: str, content: list[str], fingerprint: Column) -> DataFrame:
    """Branch identity: content, and which occurrence of that content it is. Not the position."""
    occurrence = F.row_number().over(Window.partitionBy("_branch_key").orderBy(key)).cast("bigint")
    return df.select(key, *content, fingerprint.alias("_branch_key")).withColumn("_occurrence", occurrence)


def new_branches(new: DataFrame, old: DataFrame) -> DataFrame:
    """Branches to build: those of ``new`` whose identity ``old`` lacks."""
    return new.join(old.select("_branch_key", "_occurrence"), ["_branch_key", "_occurrence"], "left_anti")
