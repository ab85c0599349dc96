"""The command line, in this process."""

from __future__ import annotations

import pytest

from rivulet.__main__ import main
from rivulet.plans import introspect
from rivulet.plans.engine import Engine
from rivulet.plans.plan import Plan, Target, dynamic_map
from rivulet.sources.store import Store

SCRIPT = """
from rivulet.plans.plan import Plan

def raw(ctx):
    return ctx.spark.range(4)

def plan(spark):
    return Plan(raw=raw, n="SELECT count(*) AS n FROM raw")
"""


@pytest.fixture
def at(spark, tmp_path):
    (tmp_path / "script.py").write_text(SCRIPT)
    return str(tmp_path / "script.py"), str(tmp_path / "store")


def test_commands(spark, at, capsys):
    def run(*args):
        capsys.readouterr()
        assert main([args[0], *at, *args[1:]]) == 0
        return capsys.readouterr().out

    assert run("outdated").split() == ["n", "raw"]
    assert "built=['raw', 'n']" in run("make")
    assert run("outdated").strip() == "" and run("missed").strip() == "" and run("recoverable").strip() == ""
    assert run("build", "n") == "n: built\n"
    assert "raw (up to date)" in run("graph") and "digraph" in run("graph", "--format", "dot") and "flowchart" in run("graph", "--format", "mermaid")
    assert "raw" in run("deps", "n") and "target" in run("history") and "done" in run("progress")
    assert "worker" in run("predict", "--jobs", "2")
    run("clean", "n")
    assert run("outdated").split() == ["n"]
    assert len(run("gc").split()) == 1
    run("unlock")
    with pytest.raises(SystemExit):
        main(["no such command", *at])


def test_branches_on_nodes_and_paths(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    plan = Plan(rows=lambda ctx: ctx.spark.range(3), out=Target("SELECT _branch_key, _occurrence FROM rows", dynamic=dynamic_map("rows")))
    engine = Engine(plan, store)
    engine.make()
    assert {r["id"]: r["branches"] for r in introspect.graph_info(engine)[0].collect()} == {"rows": None, "out": 3}
    assert store.files.exists(store.object_path("out") + "/schema.json")
    temporary = store.tempfile(".txt")
    store.files.create(temporary, "x")
    assert temporary.rpartition("/")[2] in store.gc()
    report = tmp_path / "r.py"
    report.write_text("x = read('rows')\n")
    assert introspect.deps_of_report(str(report)) == [("rows", "target")] and introspect.deps_of_report(str(tmp_path / "none.md")) == []
