"""Operators at their edges: empty tables, nulls, ties, cycles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rivulet.functions.fingerprint import table_fingerprint
from rivulet.operators import branching as b
from rivulet.operators import dag, planalgebra, records, states


def test_ordinals_do_not_depend_on_partitions(spark):
    df = spark.range(0, 1000, 3).selectExpr("id", "id % 7 AS k")
    for parts in (1, 9):
        got = b.with_ordinal(df.repartition(parts), "id", ranges=6).orderBy("id").collect()
        assert [r["_ord"] for r in got] == list(range(1, 335))
    assert b.with_ordinal(df.limit(0), "id").count() == 0
    assert [r["_ord"] for r in b.with_ordinal(spark.createDataFrame([("b",), ("a",)], "x string"), "x").orderBy("x").collect()] == [1, 2]
    nulls = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    assert [r["x"] for r in b.with_ordinal(nulls, "x").orderBy("_ord").collect()] == [None, 1, 2]


@pytest.mark.parametrize(("n", "slices"), [(0, 2), (1, 3), (5, 5), (26, 3), (50, 7)])
def test_slices(spark, n, slices):
    got = b.split(spark.range(n), slices, "id").groupBy("_slice").count().orderBy("_slice").collect()
    sizes = [r["count"] for r in got]
    assert sum(sizes) == n and (not sizes or max(sizes) - min(sizes) <= 1)
    assert sizes == sorted(sizes, reverse=True)


def test_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, o int")
    assert b.group_numbers(df, "k", "o").count() == 3
    assert {r["k"]: r["_branch"] for r in b.group_numbers(df, "k", "o", null_group="empty").collect()} == {"a": 1, "b": 2}


def test_zip_needs_equal_sizes(spark):
    with pytest.raises(ValueError, match="cannot map"):
        b.zip_map(spark.range(3), spark.range(4).withColumnRenamed("id", "j"), "id", "j")


def test_closures_on_diamonds_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert {r["id"]: r["level"] for r in dag.levels(e).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {r["id"]: r["order"] for r in dag.closure(e, spark.createDataFrame([("b",)], "id string"), direction="all", max_order=1).collect()} == {"b": 0, "a": 1, "d": 1}
    assert dag.cyclic(e).count() == 0
    loop = e.unionByName(spark.createDataFrame([("d", "b")], e.schema))
    assert {r["id"] for r in dag.cyclic(loop).collect()} == {"b", "d"}
    with pytest.raises(ValueError, match="cycle"):
        dag.levels(loop)
    assert {(r["src"], r["dst"]) for r in dag.elide(e, F.col("id") == "d").collect()} == {("a", "b"), ("a", "c"), ("b", "e"), ("c", "e")}


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, None), (None, 1)], "x int, y int")
    assert table_fingerprint(a) == table_fingerprint(a.repartition(3).orderBy("y"))
    assert table_fingerprint(a) != table_fingerprint(a.limit(1))
    swapped = spark.createDataFrame([(1, None), (1, None)], "x int, y int")
    assert table_fingerprint(a) != table_fingerprint(swapped)
    assert table_fingerprint(a) != table_fingerprint(a.withColumn("y", F.col("y").cast("long")))


def test_triggers_with_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, "x"), ("x", "x"), ("x", "y")], "o string, n string")
    got = df.select(states.changed(F.col("o"), F.col("n")).alias("c"), states.format_changed(F.col("o"), F.col("n")).alias("f")).collect()
    assert [(r["c"], r["f"]) for r in got] == [(False, False), (True, False), (False, False), (True, True)]
    with pytest.raises(ValueError, match="mode"):
        states.decide(F.lit(True), F.lit(True), "never")


def test_records(spark):
    names = spark.createDataFrame([("a",), ("ab",), ("x",)], "name string")
    assert records.last_col(names, "name").first()[0] == "x"
    assert records.all_of(names, "name", ["a", "x"]).count() == 2
    with pytest.raises(KeyError):
        records.all_of(names, "name", ["a", "q"])
    assert names.where(records.one_of(F.col("name"), "a", "q")).count() == 1
    assert names.where(records.everything(F.col("name"))).count() == 3
    assert len(records.seeded_sample(names, "name", 1, 2).collect()) == 2


def test_plan_algebra(spark):
    plan = spark.createDataFrame([("a", "f(x__)"), ("b", "g()")], "target string, command string")
    values = spark.createDataFrame([("1",), ("2",)], "value string")
    assert {(r["target"], r["command"]) for r in planalgebra.evaluate_wildcard(plan, "x__", values).collect()} == {("a_1", "f(1)"), ("a_2", "f(2)"), ("b", "g()")}
    assert planalgebra.slice_columns(plan, 5, 4).columns == []


def test_elide_through_several_vertices(spark):
    e = spark.createDataFrame([("a", "v1"), ("v1", "v2"), ("v2", "b"), ("v2", "v1"), ("v1", "c"), ("x", "y"), ("v9", "y")], "src string, dst string")
    assert {(r["src"], r["dst"]) for r in dag.elide(e, F.col("id").startswith("v")).collect()} == {("a", "b"), ("a", "c"), ("x", "y")}
    assert dag.elide(e.limit(0), F.col("id") == "a").count() == 0


def test_cycles_are_strong_components(spark):
    """Nodes between two cycles lie on none."""
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "m"), ("m", "n"), ("n", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "end"), ("s", "s"), ("s", "a"), ("y", "y")], "src string, dst string")
    got = {r["id"]: r["component"] for r in dag.strong_components(e).collect()}
    assert got == {"a": "b", "b": "b", "x": "z", "y": "z", "z": "z", "s": "s"}
    assert {r["id"] for r in dag.cyclic(e).collect()} == set(got)
    assert dag.cyclic(e.limit(0)).count() == 0


def test_strong_components_of_random_graphs(spark):
    import random

    for seed in (1,):
        r = random.Random(seed)
        pairs = {(r.randrange(25), r.randrange(25)) for _ in range(45)}
        reach = {i: {j for i2, j in pairs if i2 == i} for i in range(25)}
        for k in range(25):
            for i in range(25):
                if k in reach[i]:
                    reach[i] |= reach[k]
        want = {i: max(j for j in range(25) if j in reach[i] and i in reach[j]) for i in range(25) if i in reach[i]}
        got = dag.strong_components(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()
        assert sorted((x["id"], x["component"]) for x in got) == sorted(want.items())


def test_trace_join_keeps_rows_whole(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "b", "y"), (1, "a", "z"), (None, "q", "q")], "k int, u string, v string")
    assert {(r["k"], r["u"], r["v"]) for r in planalgebra.trace_join(left, right, ["k"]).collect()} == {(1, "a", "z"), (2, None, None)}


def test_ordinals_of_strings(spark):
    df = spark.range(2000).selectExpr("concat('k', pmod(id * 7919, 2000)) AS x", "id")
    got = b.with_ordinal(df, "x", "id", ranges=5).collect()
    assert [r["x"] for r in sorted(got, key=lambda r: r["_ord"])] == sorted(r["x"] for r in got)
    assert [r["_ord"] for r in b.with_ordinal(spark.createDataFrame([("é",), (None,), ("z",), ("😀",)], "x string"), "x").orderBy("_ord").collect()] == [1, 2, 3, 4]
