"""Wildcards, reductions, and plans as source code."""

from __future__ import annotations

import json

import pytest

from rivulet.functions.names import crop, wrap
from rivulet.plans import wildcards as w
from rivulet.plans.plan import Plan, Target, Trigger, dynamic_group, map_
from rivulet.plans.source import code_to_function, notebook_to_code, plan_source, plan_to_notebook


def row(target, command, **more):
    return {"target": target, "command": command, **more}


def test_evaluate_plan():
    plan = [row("a", "f(x__, y__)"), row("b", "g(x__)"), row("c", "h()")]
    rules = {"x__": [1, 2], "y__": ["u", "v"]}
    got = w.evaluate_plan(plan, rules, trace=True)
    assert [(r["target"], r["command"]) for r in got] == [("a_1_u", "f(1, u)"), ("a_1_v", "f(1, v)"), ("a_2_u", "f(2, u)"), ("a_2_v", "f(2, v)"), ("b_1", "g(1)"), ("b_2", "g(2)"), ("c", "h()")]
    assert got[0]["x__"] == "1" and "x__" not in got[-1]
    turns = w.evaluate_plan([row(n, "f(x__)") for n in "pqr"], {"x__": [1, 2]}, expand=False)
    assert [(r["target"], r["command"]) for r in turns] == [("p", "f(1)"), ("q", "f(2)"), ("r", "f(1)")]
    assert [r["target"] for r in w.evaluate_plan([row("p", "f(x__)")], {"x__": [1, 2]}, rename=False)] == ["p", "p_2"]
    with pytest.raises(ValueError, match="needs values"):
        w.evaluate_plan(plan, {"x__": []})


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_reductions_form_a_shallow_tree(n):
    plan = [row(f"t{i}", str(i)) for i in range(n)]
    steps = w.reduce_plan(plan, "sum", begin="(", end=")")
    assert steps[-1]["target"] == "sum" and len({s["target"] for s in steps}) == len(steps) == max(n - 1, 1)
    values, depth = {f"t{i}": i for i in range(n)}, {f"t{i}": 0 for i in range(n)}
    for s in steps:
        parts = s["command"].strip("()").split(" + ")
        assert len(parts) <= 2
        values[s["target"]] = sum(values[p] for p in parts)
        depth[s["target"]] = 1 + max(depth[p] for p in parts)
    assert values["sum"] == sum(range(n)) and depth["sum"] <= max((n - 1).bit_length(), 1)
    assert w.reduce_plan(plan, "sum", pairwise=False)[0]["command"] == " + ".join(f"t{i}" for i in range(n))
    assert w.reduce_plan([]) == []


def test_reduce_by_and_summaries():
    plan = [row(f"t{i}", "x", k=str(i % 2), u="1") for i in range(4)]
    got = w.reduce_by(plan, "k", append=False)
    assert [(r["target"], r["command"], r["k"]) for r in got] == [("reduced_0", "t0 + t2", "0"), ("reduced_1", "t1 + t3", "1")]
    assert len(w.reduce_by(plan, "k", "u", keep=lambda r: r["k"] == "1")) == 5
    data = [row("small", "s()"), row("large", "l()")]
    analyses = w.plan_analyses([row("reg", "fit(dataset__)")], data)
    assert [r["target"] for r in analyses] == ["reg_small", "reg_large"]
    made = w.plan_summaries([row("coef", "coef(analysis__, dataset__)")], analyses, data)
    assert made[0]["command"] == "list(coef_reg_small = coef_reg_small, coef_reg_large = coef_reg_large)"
    assert made[1]["command"] == "coef(reg_small, small)"
    with pytest.raises(ValueError, match="analysis__"):
        w.plan_summaries([row("x", "f()")], analyses, data)
    assert [r["target"] for r in w.expand_plan(data, [1, 2])] == ["small_1", "small_2", "large_1", "large_2"]
    assert w.gather_plan(data)[0]["command"] == "list(small = small, large = large)"


def load(ctx):
    return ctx.spark.range(3)


def test_plan_source_makes_the_same_plan():
    plan = Plan(raw=load, sql="SELECT * FROM raw", m=Target("SELECT x AS v", map_(x=[1, 2]), format="orc", trigger=Trigger(seed=False)), d=Target("SELECT 1", dynamic=dynamic_group("raw", by="id", trace="id"), retries=2))
    space = {"load": load}
    exec(plan_source(plan), space)
    again = space["plan"]
    assert list(again.targets) == list(plan.targets)
    for name, t in plan.targets.items():
        o = again[name]
        assert (o.command, o.dynamic, o.format, o.trigger, o.retries) == (t.command, t.dynamic, t.format, t.trigger, t.retries)


def test_notebooks_and_scripts(tmp_path):
    plan = Plan(b="SELECT * FROM a", a="SELECT 1 AS x")
    text = plan_to_notebook(plan, str(tmp_path / "plan.ipynb"))
    cells = json.loads(text)["cells"]
    assert [c["source"][0][:1] for c in cells] == ["a", "b"]
    assert notebook_to_code(str(tmp_path / "plan.ipynb")).startswith("a = ")
    script = tmp_path / "my script.py"
    script.write_text("import math\n\ndef twice(v):\n    return 2 * v\n\nroot = math.sqrt(total)\ntwice(root) + offset\n")
    f = code_to_function(str(script))
    assert f.__name__ == "my_script" and f(total=16, offset=1) == 9
    from rivulet.plans.deps import code_text, dependencies

    assert "sqrt" in code_text(f)
    assert dependencies(Target(f, name="t"), {"total", "offset", "other"})["targets"] == {"total", "offset"}
    assert code_to_function(str(script), result="root")(total=9, offset=0) == 3


def test_text_helpers():
    assert crop("a" * 30, 10) == "aaaaaaa..." and crop("short", 10) == "short"
    assert wrap("abcdefgh", 3) == "abc\ndef\ngh"


def test_functions_of_own_modules_are_tracked(tmp_path, monkeypatch):
    import importlib
    import sys

    from rivulet.plans.deps import function_fingerprint

    monkeypatch.syspath_prepend(str(tmp_path))
    prints = []
    for body in ("return 1", "return 2"):
        (tmp_path / "own_helpers.py").write_text(f"def used():\n    {body}\n\n\ndef unused():\n    return 0\n")
        (tmp_path / "own_command.py").write_text("import own_helpers\n\n\ndef command():\n    return own_helpers.used()\n")
        for name in ("own_helpers", "own_command"):
            sys.modules.pop(name, None)
        importlib.invalidate_caches()
        import linecache

        linecache.clearcache()
        prints.append(function_fingerprint(importlib.import_module("own_command").command))
        for cached in (tmp_path / "__pycache__").glob("*"):
            cached.unlink()
    assert prints[0] != prints[1]


def test_plans_as_one_query(spark):
    from rivulet.plans.inline import evaluate
    from rivulet.plans.plan import combine_, dynamic_map, split_

    plan = Plan(part=Target(lambda rows: rows.count(), split_("rows", 3)), sizes=Target(lambda part: sorted(part), combine_("part")), n="SELECT count(*) AS n FROM rows", d=Target("SELECT 1", dynamic=dynamic_map("n")))
    rows = spark.range(10)
    assert evaluate(plan, spark, "sizes", rows=rows) == [3, 3, 4]
    assert evaluate(plan, spark, "n", rows=rows).first()["n"] == 10
    with pytest.raises(ValueError, match="dynamic"):
        evaluate(plan, spark, "d", rows=rows)
