"""Traces, groups over several targets, watched files, memory strategies, logging and reports."""

from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from rivulet.functions.fingerprint import row_fingerprint
from rivulet.plans.deps import file_out, report_in
from rivulet.plans.engine import Engine
from rivulet.plans.memory import STRATEGIES
from rivulet.plans.plan import Plan, Target, dynamic_group, dynamic_map
from rivulet.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def sales(ctx):
    return ctx.spark.createDataFrame([(1, "z", 10), (2, "a", 20), (3, "z", 30), (4, None, 40)], "i int, k string, v int")


def days(ctx):
    return ctx.spark.createDataFrame([(1, "mon"), (2, "tue"), (3, "mon"), (4, "tue")], "j int, day string")


def sums(sales):
    return sales.groupBy("_branch_key", "_occurrence").agg(F.sum("v").alias("s"))


def test_groups_are_numbered_by_first_appearance(store):
    plan = Plan(sales=sales, total=Target(sums, dynamic=dynamic_group("sales", by="k", trace="k")))
    Engine(plan, store).make()
    assert [r["s"] for r in store.read("total").orderBy("_branch").collect()] == [40, 20, 40]
    trace = store.read_trace("k", "total")
    assert [(r["_branch"], r["k"]) for r in trace.orderBy("_branch").collect()] == [(1, "z"), (2, "a"), (3, None)]
    names = [r["subtarget"] for r in store.subtargets("total").orderBy("_branch").collect()]
    assert len(set(names)) == 3 and all(n.startswith("total_") and len(n) == 14 for n in names)
    assert store.subtargets("total", [2]).count() == 1
    with pytest.raises(KeyError):
        store.read_trace("v", "total")
    with pytest.raises(ValueError, match="no branches"):
        store.subtargets("sales")
    store.gc()
    assert store.read_trace("k", "total").count() == 3
    assert Engine(plan, store).make().built == []


def test_group_over_several_targets_by_another(store):
    plan = Plan(sales=sales, days=days, total=Target(sums, dynamic=dynamic_group("sales", by="days.day")), both=Target(sums, dynamic=dynamic_group("sales", "days", by="day")))
    Engine(plan, store).make()
    for name in ("total", "both"):
        assert [r["s"] for r in store.read(name).orderBy("_branch").collect()] == [40, 60]
    short = Plan(sales=sales, days="SELECT 1 AS j, 'mon' AS day", total=Target(sums, dynamic=dynamic_group("sales", by="days.day")))
    report = Engine(short, store).make(keep_going=True)
    assert report.failed == ["total"] and "different sizes" in store.diagnose("total")["error"]


def test_traces_of_maps_and_repeated_rows(store):
    rows = lambda ctx: ctx.spark.createDataFrame([(1, "x"), (2, "y")], "i int, k string")
    plan = Plan(rows=rows, out=Target("SELECT _branch_key, _occurrence, upper(k) AS u FROM rows", dynamic=dynamic_map("rows", trace=("i", "k"))))
    Engine(plan, store).make()
    assert [(r["i"], r["k"]) for r in store.branches("out").orderBy("_branch").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(RuntimeError, match="cannot trace"):
        Engine(Plan(rows=rows, bad=Target("SELECT _branch_key, _occurrence FROM rows", dynamic=dynamic_map("rows", trace="q"))), store).make()


def test_watched_files(store, tmp_path):
    path = tmp_path / "out.txt"

    def written():
        path.write_text("one")
        return str(path)

    plan = Plan(out=Target(written, format="file"), size=lambda out: len(out))
    assert Engine(plan, store).make().built == ["out", "size"]
    assert store.read("out") == str(path)
    assert Engine(plan, store).make().built == []
    path.write_text("changed")
    assert "out" in Engine(plan, store).outdated()
    assert Engine(plan, store).make().built == ["out"]  # the same content again, so size stays
    path.unlink()
    assert Engine(plan, store).reasons(plan["out"]) == ["file"]
    with pytest.raises(RuntimeError, match="do not exist"):
        Engine(Plan(none=Target(lambda: "/nowhere/at/all", format="file")), store).make()


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_memory_strategies(store, strategy):
    plan = Plan(a=sales, b="SELECT i, v FROM a", c=lambda a, b: a.join(b, "i").count(), d=Target("SELECT count(*) AS n FROM b", memory="unload"))
    engine = Engine(plan, store, memory=strategy)
    kept = []
    begin = engine.memory.begin
    engine.memory.begin = lambda *x: (begin(*x), kept.append(set(engine.memory.held)))
    assert engine.make(jobs=2).built.__len__() == 4
    assert store.read("c") == 4 and store.read("d").first()["n"] == 4
    assert engine.memory.held == {}  # nothing stays after a run
    if strategy in ("none", "unload"):
        assert not any(kept)
    if strategy == "speed":
        assert any(kept)
    with pytest.raises(ValueError, match="memory strategy"):
        Engine(plan, store, memory="most")


def test_log_prework_and_missing_output(store, tmp_path):
    ran = []

    def lazy():
        file_out("/tmp/never-written-by-this-test.txt")
        return 1

    log = str(tmp_path / "make.log")
    engine = Engine(Plan(x=Target(lazy, parallel=False), y=lambda x: x + 1), store, prework=(lambda s: ran.append(s.version),), log_path=log)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        engine.make()
    assert len(ran) == 1 and any("did not write" in str(w.message) for w in caught)
    text = store.files.read(log)
    assert "target x" in text and "target y" in text
    assert engine.make(skip_targets=True).built == []


def test_reports_and_reads_are_dependencies(store, tmp_path):
    report = tmp_path / "report.md"
    report.write_text("# Numbers\n\n```python\nt = read('small')\nload('other')\n```\n")
    code = f"def rendered(ctx):\n    from rivulet.plans.deps import report_in\n    report_in({str(report)!r})\n    return ctx.read('small').count()\n"
    source = tmp_path / "code.py"
    source.write_text(code)
    import importlib.util

    spec = importlib.util.spec_from_file_location("report_code", source)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    plan = Plan(small=sales, other="SELECT 1 AS one", done=module.rendered)
    engine = Engine(plan, store)
    assert engine.deps["done"]["targets"] == {"small", "other"}
    engine.make()
    assert store.read("done") == 4
    report.write_text(report.read_text() + "more")
    assert Engine(plan, store).outdated() == ["done"]
    assert report_in("a", "b") == ("a", "b")


def test_export_memo_log_and_rescue(store, tmp_path):
    Engine(Plan(sales=sales, total=Target(sums, dynamic=dynamic_group("sales", by="k"))), store).make()
    other = store.export_to(str(tmp_path / "other"))
    assert sorted(other.cached()) == ["sales", "total"] and other.subtargets("total").count() == 3
    assert other.history().count() == 2
    calls = []
    for _ in range(2):
        assert store.memo(("k", 1), lambda: calls.append(1) or 7) == 7
    assert calls == [1]
    store.gc()
    assert store.memo(("k", 1), lambda: 8) == 7
    store.write_cache_log(str(tmp_path / "log.csv"))
    assert (tmp_path / "log.csv").read_text().splitlines()[0] == "hash,format,target"
    assert store.load(select=lambda n: n.startswith("s")) == ["sales"]
    hash_ = store.diagnose("total")["hash"]
    for part in (tmp_path / "store" / "objects" / hash_ / "table").glob("part-*"):
        part.write_bytes(b"broken")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert store.rescue() == ["total"]


def test_files_are_replaced_in_one_step(store, tmp_path):
    path = str(tmp_path / "x.json")
    for text in ("a", "bb"):
        store.files.write(path, text)
        assert store.files.read(path) == text
    assert [n for n in store.files.names(str(tmp_path)) if n.startswith("x.json")] == ["x.json"]


def test_branch_rows_keep_fingerprints(spark):
    assert spark.range(1).select(row_fingerprint("id")).first()[0]
