"""Queries and operators over all of their input."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from rivulet.operators import dag

SF = Path("/root/testdata/sf0.001")


def test_predicted_workers_run_all_targets(spark):
    from rivulet.queries import QUERIES, Tables
    from rivulet.queries.dags import edges, times

    t = Tables(spark, str(SF))
    rows = {r["target"]: r for r in QUERIES["predict_workers"](spark, str(SF)).collect()}
    e, known = [tuple(r) for r in edges(t, t.orders).collect()], {r["id"]: r["time"] for r in times(t, t.orders).collect()}
    orders = {f"o{r['o_orderkey']}" for r in t.orders.select("o_orderkey").collect()}
    assert set(rows) == {x for pair in e for x in pair} | set(known) and orders <= set(rows)
    assert all(r["end"] - r["start"] == known.get(x, 0) for x, r in rows.items())
    assert all(rows[a]["end"] <= rows[b]["start"] for a, b in e)
    for worker in (1, 2, 3):
        busy = sorted((r["start"], r["end"]) for r in rows.values() if r["worker"] == worker)
        assert all(x[1] <= y[0] for x, y in zip(busy, busy[1:]))


def test_file_fingerprint_is_of_the_whole_text(spark):
    from rivulet.queries.states import sides

    rows = [(k, "s", "en", "x" * 300 + str(k), 301) for k in (1, 2)]
    t = SimpleNamespace(documents=spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long"))
    for side in sides(t):
        assert len({r["file_in"] for r in side.collect()}) == 2


@pytest.mark.parametrize("f", [lambda e: dag.levels(e, 2), lambda e: dag.longest_path(e, e.selectExpr("src AS id", "1 AS time"), 2), lambda e: dag.cyclic(e, 1)])
def test_bounds_are_not_silent(spark, f):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)], "src string, dst string")
    with pytest.raises(RuntimeError, match="no end"):
        f(chain)
    assert dag.levels(chain).count() == 7 and dag.cyclic(chain).count() == 0
