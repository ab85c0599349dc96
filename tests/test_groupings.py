"""Variables of earlier targets in ``map_``, ``cross_`` and ``combine_``."""

from __future__ import annotations

import pytest

from rivulet.plans.deps import dependencies, file_out
from rivulet.plans.plan import Plan, Target, combine_, cross_, map_


def names(plan, family):
    return [n for n, t in plan.targets.items() if t.trace.get(family) == n]


def test_two_maps_over_one_family_have_a_target_for_each_of_it():
    plan = Plan(s=Target("SELECT v", map_(v=[1, 2])), a=Target("SELECT * FROM s", map_("s")), b=Target("SELECT * FROM s", map_("s")), c=Target("SELECT * FROM b", map_("b", "a")))
    assert [len(names(plan, x)) for x in "sabc"] == [2, 2, 2, 2]
    assert [(plan[n].trace["b"], plan[n].trace["a"]) for n in names(plan, "c")] == [("b_s_1", "a_s_1"), ("b_s_2", "a_s_2")]  # no trace has both, so they are zipped


def test_blocks_of_variables_are_zipped_and_cut_to_the_shortest():
    plan = Plan(
        x=Target("SELECT p, q", map_(p=["a", "b", "c"], q=["k", "l", "m"])),
        y=Target("SELECT r", map_(r=["u", "v"])),
        z=Target("SELECT 'z'", map_("p", "q", "r")),
    )
    rows = [(t.trace["p"], t.trace["q"], t.trace["r"]) for n, t in plan.targets.items() if t.trace.get("z") == n]
    assert rows == [("a", "k", "u"), ("b", "l", "v")]


def test_only_traces_with_the_whole_block_count():
    plan = Plan(
        x=Target("SELECT p", map_(p=["a", "b", "c"])),
        y=Target("SELECT 1", cross_("x", w=["k"])),
        z=Target("SELECT 'z'", map_("p", "w")),
    )
    rows = [(t.trace["p"], t.trace["w"]) for n, t in plan.targets.items() if t.trace.get("z") == n]
    assert rows == [("a", "k"), ("b", "k"), ("c", "k")]


def test_a_variable_alone_counts_each_value_once():
    plan = Plan(x=Target("SELECT p, q", cross_(p=["a", "b"], q=["k", "l"])), y=Target("SELECT 'p'", map_("p")))
    assert [plan[n].trace["p"] for n in names(plan, "y")] == ["a", "b"]


def nested():
    return Plan(
        i=Target("SELECT p", map_(p=[1, 2])),
        a=Target("SELECT x FROM i", cross_("i", x=[1, 2])),
        b=Target("SELECT y FROM a", cross_("a", y=[1, 2], id=("p", "x"))),
        d=Target("SELECT * FROM b", combine_("b", by="a")),
    )


def test_nested_variables_go_along():
    plan = nested()
    assert all({"p", "i", "x"} <= set(plan[n].trace) for n in names(plan, "a"))
    assert {n for n in names(plan, "b")} >= {"b_1_1", "b_2_1", "b_1_2", "b_2_2"}
    d = [plan[n].trace for n in names(plan, "d")]
    assert len(d) == 4 and all(set(t) == {"p", "i", "x", "a", "d"} for t in d)
    assert {(t["p"], t["x"], t["i"], t["a"]) for t in d} == {(plan[n].trace["p"], plan[n].trace["x"], plan[n].trace["i"], n) for n in names(plan, "a")}


def test_what_went_along_with_a_combination_can_be_grouped_by():
    plan = nested()
    more = Plan(
        i=Target("SELECT p", map_(p=[1, 2])),
        a=Target("SELECT x FROM i", cross_("i", x=[1, 2])),
        d=Target("SELECT * FROM a", combine_("a", by="i")),
        e=Target("SELECT * FROM d", combine_("d", by="p")),
    )
    assert len(names(more, "e")) == 2 and len(names(plan, "d")) == 4
    assert {more[n].trace["i"] for n in names(more, "e")} == {"i_1", "i_2"}


def helper():
    return file_out("made.txt")


def deeper():
    return helper()


def calls_deeper():
    return deeper()


def test_files_are_not_written_by_helpers():
    for command in (deeper, calls_deeper):
        with pytest.raises(ValueError, match="made.txt"):
            dependencies(Target(command, name="t"), {"t"})
    assert dependencies(Target(helper, name="t"), {"t"})["file_out"] == {"made.txt"}
