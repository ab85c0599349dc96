"""Fingerprints of rows, values and whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(*columns: str | Column) -> Column:
    """The columns as one text, each value after its length, so that unlike rows have unlike texts; null is ``-``."""
    texts = [(F.col(f"`{c}`") if isinstance(c, str) else c).cast("string") for c in columns]
    return F.concat_ws("|", *[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.char_length(c).cast("string"), F.lit(":"), c)) for c in texts])


def row_fingerprint(*columns: str | Column) -> Column:
    return F.md5(row_text(*columns))


def rows_fingerprint(*columns: str) -> Column:
    """Aggregate: the fingerprint of a group as a multiset of rows."""
    half = lambda at: F.conv(F.substring(row_fingerprint(*columns), at, 14), 16, 10).cast("decimal(38,0)")
    return F.md5(F.concat_ws("|", F.count(F.lit(1)), F.sum(half(1)), F.sum(half(15))))


def row_hash(*columns: str) -> Column:
    """64-bit hash; whether a value is null is hashed too, because xxhash64 skips nulls."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def _hashable(df: DataFrame) -> DataFrame:
    """Maps cannot be hashed; their entries, sorted by key, can."""
    return df.select(*[F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map<") else F.col(f"`{c}`") for c, t in df.dtypes])


def table_fingerprint(df: DataFrame) -> str:
    """Fingerprint of a table as a multiset of rows, whatever their order or partitions.

    One pass with a partial aggregate; a single row comes to the driver.
    """
    rows = _hashable(df)
    h = row_hash(*rows.columns) if rows.columns else F.lit(0).cast("bigint")
    n, total, mixed = rows.select(h.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    text = f"{df.schema.json()}|{n}|{total}|{mixed}"
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()
