"""The static grammar, dependencies and scheduling; no Spark needed."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rivulet.functions.names import make_unique, sanitize
from rivulet.operators.branching import spaced_ordinals
from rivulet.plans import deps as d
from rivulet.plans.plan import Plan, Ref, Target, code_to_plan, combine_, cross_, map_, plan_to_code, split_
from rivulet.plans.schedule import ReadyQueue, simulate


def test_map_zips_values():
    plan = Plan(fit=Target("SELECT x, y", map_(x=[1, 2], y=["a", "b"])))
    assert [(n, t.command) for n, t in plan.targets.items()] == [("fit_1_a", "SELECT 1, a"), ("fit_2_b", "SELECT 2, b")]


def test_map_needs_whole_multiples():
    assert len(Plan(f=Target("SELECT x, y", map_(x=[1, 2, 3, 4], y=[5, 6])))) == 4
    with pytest.raises(ValueError, match="cannot map over"):
        Plan(f=Target("SELECT x, y", map_(x=[1, 2, 3], y=[5, 6])))


def test_cross_varies_first_fastest():
    plan = Plan(f=Target("SELECT x, y", cross_(x=[1, 2], y=["a", "b"])))
    assert list(plan.targets) == ["f_1_a", "f_2_a", "f_1_b", "f_2_b"]


def test_following_and_combining_families():
    plan = Plan(
        data=Target("SELECT * FROM raw WHERE k = x", map_(x=[1, 2])),
        fit=Target("SELECT sum(v) AS s, x AS x FROM data", map_("data")),
        all=Target("SELECT * FROM fit", combine_("fit")),
        each=Target("SELECT * FROM fit", combine_("fit", by="x")),
    )
    assert plan["fit_data_1"].command == "SELECT sum(v) AS s, 1 AS 1 FROM data_1"
    assert plan["all"].bindings["fit"] == [Ref("fit_data_1"), Ref("fit_data_2")]
    assert {"each_1", "each_2"} <= set(plan.targets)
    assert ("data_1", "fit_data_1") in d.graph(plan)
    assert ("fit_data_2", "all") in d.graph(plan)


def test_split_binds_slices():
    plan = Plan(big=Target("SELECT 1 AS a"), part=Target(lambda big: big, split_("big", 3)))
    assert list(plan.targets) == ["big", "part_1", "part_2", "part_3"]


def test_max_expand_keeps_evenly_spaced():
    plan = Plan(f=Target("SELECT x", map_(x=list(range(1, 101)))), max_expand=3)
    assert list(plan.targets) == ["f_1", "f_50", "f_100"]
    assert spaced_ordinals(26, 5) == [1, 7, 13, 19, 26]
    assert spaced_ordinals(26 * 26 * 4, 8) == [1, 387, 773, 1159, 1545, 1931, 2317, 2704]


def test_names_ids_and_tags():
    plan = Plan(f=Target("SELECT x", map_(x=["a", "b"], id=False, tag_out="made")), g=Target("SELECT 1 FROM made", map_("made", target_names=["u", "v"])))
    assert list(plan.targets) == ["f_1", "f_2", "u", "v"]
    assert plan["u"].command == "SELECT 1 FROM f_1"
    with pytest.raises(ValueError, match="as many names"):
        Plan(f=Target("SELECT x", map_(x=[1, 2], target_names=["one"])))


def test_guards():
    with pytest.raises(ValueError, match="something to branch over"):
        map_()
    with pytest.raises(ValueError, match="different names"):
        Plan.bind(Plan(a="SELECT 1"), Plan(a="SELECT 2"))
    with pytest.raises(ValueError, match="names of targets"):
        Plan(x="SELECT 1", f=Target("SELECT x", map_(x=[1])))
    with pytest.raises(ValueError, match="circular"):
        d.build_order(Plan(a="SELECT * FROM b", b="SELECT * FROM a"))


def test_names():
    assert make_unique(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]
    assert sanitize(" 1 b-c. ") == "X1.b.c_"


@given(st.lists(st.sampled_from("abc")))
def test_unique_names_are_unique_and_stable(names):
    out = make_unique(names)
    assert len(set(out)) == len(out) or any("_" in n for n in names)
    assert [o.split("_")[0] for o in out] == names


def test_sql_dependencies():
    assert d.sql_relations("WITH a AS (SELECT * FROM b) SELECT * FROM a, c JOIN d ON x = 'from e' -- from f") == {"b", "c", "d"}
    assert d.sql_text("SELECT  1 -- one\n, 2 /* two */") == "SELECT 1 , 2"


def helper(x):
    return x + 1


def uses_helper(raw):
    """Documentation does not count."""
    return helper(raw)  # nor do comments


def test_function_dependencies():
    assert d.dependencies(Target(uses_helper, name="t"), {"raw"})["targets"] == {"raw"}
    assert d.dependencies(Target(uses_helper, name="t"), {"raw"})["functions"] == {"helper"}


def reads_files():
    return d.file_in("in.csv"), d.file_out("out.csv")


def later():
    return d.file_in("out.csv")


def test_files_make_edges():
    plan = Plan(a=reads_files, b=later)
    assert d.graph(plan) == [("a", "b")]


def test_code_round_trip():
    assert list(code_to_plan("CREATE VIEW a AS SELECT 1; CREATE VIEW b AS SELECT * FROM a;").targets) == ["a", "b"]
    assert code_to_plan('x = "SELECT 1"')["x"].command == "SELECT 1"
    assert plan_to_code(Plan(a="SELECT 1")) == "a = SELECT 1\n"


def test_predicted_runtime():
    edges, times = [("myinput", "nextone")], {"myinput": 10, "nextone": 33, "yourinput": 27}
    assert simulate(edges, times, 1)[0] == 70
    assert simulate(edges, times, 2)[0] == 43
    assert simulate(edges, times, 1, stale=set())[0] == 0


def test_ready_queue():
    q = ReadyQueue({"b": 1, "a": 0, "c": 2})
    assert [q.pop(), q.pop()] == ["a", None]
    q.decrease("b", "c")
    assert [q.pop(), q.pop()] == ["b", None]
