"""Names of targets and branches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sanitize_name(c: Column) -> Column:
    """A name of letters, digits, dots and underscores that starts with a letter and ends without a dot."""
    c = F.regexp_replace(F.trim(c), "[^A-Za-z0-9_.]", ".")
    c = F.when(c.rlike("^([0-9_]|[.][0-9])"), F.concat(F.lit("X"), c)).otherwise(c)
    return F.regexp_replace(c, "[.]$", "_")


def sanitize(name: str) -> str:
    """As :func:`sanitize_name`, for one name."""
    name = re.sub(r"[^A-Za-z0-9_.]", ".", name.strip(" "))
    if re.match(r"[0-9_]|[.][0-9]", name):
        name = "X" + name
    return re.sub(r"[.]$", "_", name)


def with_unique_names(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """The second and later rows with a name get ``_2``, ``_3`` and so on, in the given order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn(out, F.when(k == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), k.cast("string"))))


def make_unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def branch_name(parent: str, *columns: str | Column) -> Column:
    """Parent, underscore, and eight digits of the content's md5."""
    return F.concat(F.lit(parent + "_"), F.substring(F.md5(F.concat_ws(" ", *columns)), 1, 8))


def crop(text: str, length: int = 20) -> str:
    """At most ``length`` characters, the last three dots if something was cut."""
    return text if len(text) <= length else text[: max(length - 3, 0)] + "..."


def wrap(text: str, width: int) -> str:
    """Lines of at most ``width`` characters, cut wherever that falls; for names on drawings."""
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))
