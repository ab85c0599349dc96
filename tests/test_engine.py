"""Making plans: what is built, skipped and recovered."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rivulet.plans import introspect
from rivulet.plans.engine import Cancelled, Engine, Failed
from rivulet.plans.plan import Plan, Target, Trigger, combine_, dynamic_cross, dynamic_group, dynamic_map, map_, split_
from rivulet.sources.store import Locked, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def numbers(ctx):
    return ctx.spark.range(1, 11).withColumnRenamed("id", "v")


def test_second_make_builds_nothing(store):
    plan = lambda sql: Plan(raw=numbers, total=sql)
    assert Engine(plan("SELECT sum(v) AS s FROM raw"), store).make().built == ["raw", "total"]
    again = Engine(plan("SELECT  sum(v) AS s\nFROM raw -- the same"), store)
    assert again.make().built == [] and again.outdated() == []
    assert store.read("total").first()["s"] == 55
    changed = Engine(plan("SELECT sum(v) + 1 AS s FROM raw"), store)
    assert changed.outdated() == ["total"]
    assert changed.make().built == ["total"]


def test_early_cut_off(store):
    Engine(Plan(raw=numbers, small="SELECT v FROM raw WHERE v < 3", n="SELECT count(*) AS n FROM small"), store).make()
    report = Engine(Plan(raw=numbers, small="SELECT v FROM raw WHERE v <= 2", n="SELECT count(*) AS n FROM small"), store).make()
    assert report.built == ["small"]


def test_recovery(store):
    one, two = Plan(raw=numbers, n="SELECT count(*) AS n FROM raw"), Plan(raw=numbers, n="SELECT count(*) + 1 AS n FROM raw")
    Engine(one, store).make()
    Engine(two, store).make()
    engine = Engine(one, store)
    assert engine.recoverable() == ["n"]
    report = engine.make(recover=True)
    assert (report.built, report.recovered) == ([], ["n"])
    assert store.read("n").first()["n"] == 10


def test_history_and_clean(store):
    Engine(Plan(raw=numbers, n="SELECT 1 AS n"), store).make()
    Engine(Plan(raw=numbers, n="SELECT 2 AS n"), store).make()
    rows = store.history().where("target = 'n'").collect()
    assert [(r["exists"], r["current"]) for r in rows] == [(True, False), (True, True)]
    store.clean("n")
    assert store.cached() == ["raw"]
    assert len(store.gc()) == 2
    assert {r["exists"] for r in store.history().where("target = 'n'").collect()} == {False}


def test_failures(store):
    def broken():
        raise RuntimeError("no")

    plan = Plan(a=broken, b=lambda a: a, c=lambda: 3)
    with pytest.raises(Failed, match="no"):
        Engine(plan, store).make()
    report = Engine(plan, store).make(keep_going=True)
    assert report.failed == ["a"] and "b" not in report.built
    assert store.diagnose("a")["error"].endswith("no")
    assert [r["target"] for r in store.progress("failed").collect()] == ["a"]
    assert "a" in Engine(plan, store).outdated()
    assert store.read("c") == 3


def test_retries_timeouts_and_cancelling(store):
    tried = []

    def third():
        tried.append(1)
        if len(tried) < 3:
            raise ValueError
        return 1

    def slow():
        import time

        time.sleep(1.5)
        return 1

    def gives_up():
        raise Cancelled

    assert Engine(Plan(x=Target(third, retries=2)), store).make().built == ["x"]
    assert Engine(Plan(y=Target(slow, elapsed=0.3)), store).make(keep_going=True).failed == ["y"]
    Engine(Plan(z=lambda: 5), store).make()
    assert Engine(Plan(z=gives_up), store).make().cancelled == ["z"]
    assert store.read("z") == 5


def test_lock(store):
    store.lock()
    with pytest.raises(Locked):
        Engine(Plan(a=lambda: 1), store).make()
    store.unlock()
    Engine(Plan(a=lambda: 1), store).make()


@pytest.mark.parametrize(
    ("mode", "condition", "changed", "builds"),
    [("whitelist", True, False, True), ("whitelist", False, False, False), ("whitelist", False, True, True), ("blacklist", False, True, False), ("blacklist", True, True, True), ("blacklist", True, False, False), ("condition", True, False, True), ("condition", False, True, False)],
)
def test_trigger_modes(store, mode, condition, changed, builds):
    Engine(Plan(a="SELECT 1 AS x"), store).make()
    t = Target("SELECT 2 AS x" if changed else "SELECT 1 AS x", trigger=Trigger(condition=condition, mode=mode))
    assert (Engine(Plan(a=t), store).make().built == ["a"]) is builds


def test_files_are_watched(store, tmp_path, spark):
    path = tmp_path / "in.txt"
    path.write_text("one")
    source = f"from rivulet.plans.deps import file_in\ndef read(ctx):\n    return ctx.spark.read.text(file_in({str(path)!r}))\n"
    (tmp_path / "mod_reads.py").write_text(source)
    import sys

    sys.path.insert(0, str(tmp_path))
    import mod_reads

    plan = Plan(a=mod_reads.read)
    assert Engine(plan, store).make().built == ["a"]
    assert Engine(plan, store).make().built == []
    path.write_text("two!")
    assert Engine(plan, store).make().built == ["a"]
    path.unlink()
    assert Engine(plan, store).missed() == [str(path)]


def squared(values):
    return values.withColumn("sq", F.col("v") * F.col("v"))


def test_dynamic_map_builds_new_branches_only(store):
    def plan(vs):
        return Plan(values=lambda ctx: ctx.spark.createDataFrame([(v,) for v in vs], "v int"), squares=Target(squared, dynamic=dynamic_map("values", order="v")))

    assert Engine(plan([1, 2, 3, 4]), store).make().branches == {"squares": 4}
    assert sorted(r["sq"] for r in store.read("squares").collect()) == [1, 4, 9, 16]
    report = Engine(plan([1, 7, 8, 4]), store).make()
    assert report.branches == {"squares": 2}
    assert [r["sq"] for r in store.read("squares").orderBy("_branch").collect()] == [1, 16, 49, 64]
    assert Engine(plan([1, 4]), store).make().branches == {"squares": 0}
    assert Engine(plan([5, 5, 5]), store).make().branches == {"squares": 3}
    assert Engine(plan([5, 5, 5, 5]), store).make().branches == {"squares": 1}
    assert [r["_branch"] for r in store.read("squares", branches=[2]).collect()] == [2]


def by_group(values):
    return values.groupBy("g", "_branch_key", "_occurrence").agg(F.sum("v").alias("s"))


def test_dynamic_group_and_cross(store):
    rows = lambda ctx: ctx.spark.createDataFrame([("b", 2), ("b", 3), ("b", 10), ("a", 9)], "g string, v int")
    Engine(Plan(values=rows, sums=Target(by_group, dynamic=dynamic_group("values", by="g"))), store).make()
    assert {r["g"]: r["s"] for r in store.read("sums").collect()} == {"a": 9, "b": 15}
    letters = lambda ctx: ctx.spark.createDataFrame([("a",), ("b",)], "x string")
    capitals = lambda ctx: ctx.spark.createDataFrame([("A",), ("B",)], "y string")
    both = Target(lambda small: small.withColumn("xy", F.concat("x", "y")), dynamic=dynamic_cross("small", "large"))
    Engine(Plan(small=letters, large=capitals, both=both), store).make()
    assert [r["xy"] for r in store.read("both").orderBy("_branch").collect()] == ["aA", "aB", "bA", "bB"]


def test_static_families_and_jobs(store):
    plan = Plan(
        raw=numbers,
        part=Target("SELECT * FROM raw WHERE v % 2 = r", map_(r=[0, 1])),
        sums=Target("SELECT sum(v) AS s FROM part", map_("part")),
        all=Target(lambda sums: sum(x.first()["s"] for x in sums), combine_("sums")),
        piece=Target(lambda raw: raw.count(), split_("raw", 3)),
    )
    report = Engine(plan, store).make(jobs=3)
    assert len(report.built) == len(plan)
    assert store.read("all") == 55
    assert [store.read(f"piece_{i}") for i in (1, 2, 3)] == [4, 3, 3]


def test_introspection(store):
    plan = Plan(raw=numbers, n="SELECT count(*) AS n FROM raw", m="SELECT n + 1 AS m FROM n")
    engine = Engine(plan, store)
    assert introspect.predict(engine, 1, from_scratch=True, known_times={"raw": 1, "n": 2, "m": 3})[0] == 6
    engine.make(["n"])
    nodes, edges = introspect.graph_info(Engine(plan, store))
    assert {r["id"]: (r["status"], r["level"]) for r in nodes.collect()} == {"raw": ("up to date", 0), "n": ("up to date", 1), "m": ("missing", 2)}
    assert "n (up to date) <- raw" in introspect.to_text(nodes, edges)
    assert '"raw" -> "n"' in introspect.to_dot(nodes, edges)
    assert introspect.build_times(engine).count() == 2
    assert engine.tracked() == ["m", "n", "numbers", "raw"] or "raw" in engine.tracked()
    assert engine.profile("n").where("changed").count() == 0


def test_import_and_rescue(store, spark, tmp_path):
    Engine(Plan(a=lambda: 1, b="SELECT 1 AS x"), store).make()
    other = Store(spark, str(tmp_path / "other"))
    other.import_from(store)
    assert other.cached() == ["a", "b"] and other.read("a") == 1
    other.files.delete(f"{other.path}/objects/{other.meta('a')['hash']}")
    assert other.rescue() == ["a"]
    assert other.cached() == ["b"]


def test_streaming(store, spark, tmp_path):
    from rivulet.streaming.incremental import make_on_arrival

    incoming, table = tmp_path / "in", tmp_path / "table"
    spark.range(5).write.parquet(str(incoming))
    plan = Plan(n=Target(lambda ctx: ctx.spark.read.parquet(str(table)).count(), trigger=Trigger(condition=True)))
    stream = spark.readStream.schema("id long").parquet(str(incoming))
    make_on_arrival(stream, str(table), str(tmp_path / "check"), lambda: Engine(plan, store)).awaitTermination()
    assert store.read("n") == 5
