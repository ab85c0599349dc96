"""A plan as one lazy query: nothing is stored, and Catalyst sees all commands at once."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.branching import split
from rivulet.plans.deps import sql_relations
from rivulet.plans.plan import Plan, Ref, Slice
from rivulet.plans.relations import with_frames


def run_sql(spark: SparkSession, text: str, frames: dict[str, DataFrame]) -> DataFrame:
    """A query over frames by name. The names hold for this query only, so queries made at the same time do not meet."""
    if not frames:
        return spark.sql(text)
    words = {n: f"frame{i}" for i, n in enumerate(frames)}  # a name may hold dots, a placeholder may not
    return spark.sql(with_frames(text, words, spark), **{words[n]: x for n, x in frames.items()})


def evaluate(plan: Plan, spark: SparkSession, name: str, **inputs: Any) -> Any:
    """The value of a target, with ``inputs`` for the names that the plan does not define.

    Every target is evaluated once. Dynamic targets need a store and an engine.
    """
    known: dict[str, Any] = dict(inputs)

    def value(n: str) -> Any:
        if n not in known:
            t = plan[n]
            if t.dynamic:
                raise ValueError(f"{n} is dynamic; make the plan with an engine")
            bound = {k: resolved(v) for k, v in t.bindings.items()}
            if callable(t.command):
                known[n] = t.command(**{p: bound[p] if p in bound else value(p) for p in t.parameters() if p in bound or p in plan.targets or p in inputs})
            else:
                sliced = {k: v for k, v in bound.items() if isinstance(t.bindings[k], Slice)}
                wanted = sql_relations(t.command) | {r.target for v in t.bindings.values() if isinstance(v, list) for r in v if re.search(rf"\b{re.escape(r.target)}\b", t.command)}
                known[n] = run_sql(spark, t.command, {**{r: value(r) for r in wanted if r in plan.targets or r in inputs}, **sliced})
        return known[n]

    def resolved(v: Any) -> Any:
        if isinstance(v, Ref):
            return value(v.target)
        if isinstance(v, Slice):
            rows = value(v.of.target)
            return split(rows, v.slices, *rows.columns).where(F.col("_slice") == v.index).drop("_slice")
        return [resolved(x) for x in v] if isinstance(v, list) else v

    return value(name)
