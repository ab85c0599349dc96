"""Random numbers that depend on a seed and counters alone: not on partitions, order or other rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str | Column, *counters: str | Column, stream: int = 0) -> Column:
    """A number of [0, 1) for each seed (such as the column ``_seed`` of a branch) and counters; other streams give others."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(stream), seed, *counters), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def normal(seed: str | Column, *counters: str | Column, stream: int = 0) -> Column:
    """A number of the standard normal distribution, likewise."""
    a, b = uniform(seed, *counters, stream=2 * stream + 1), uniform(seed, *counters, stream=2 * stream + 2)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)
