"""Scheduler pools and resources of targets, and plans from scripts with commands in Python."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from rivulet.plans import resources
from rivulet.plans.engine import Engine
from rivulet.plans.plan import Plan, Target, code_to_plan, dynamic_map, plan_to_code
from rivulet.sources.store import Store


def where(ctx):
    """The pool that the tasks of a command's job see."""
    see = F.udf(lambda _: TaskContext.get().getLocalProperty("spark.scheduler.pool"), "string")
    return ctx.spark.range(1).select(see("id").alias("pool"))


def test_each_target_in_its_pool(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    plan = Plan(a=Target(where, pool="first"), b=Target(where, pool="second"), c=where)
    Engine(plan, store).make(jobs=3)
    assert [store.read(n).first()["pool"] for n in "ab"] == ["first", "second"]
    assert store.read("c").first()["pool"] not in ("first", "second")
    assert spark.sparkContext.getLocalProperty(resources.POOL) is None


def test_pool_is_put_back_after_an_error(spark):
    with pytest.raises(ZeroDivisionError), resources.in_pool(spark, "other"):
        assert spark.sparkContext.getLocalProperty(resources.POOL) == "other"
        1 / 0  # noqa: B018
    assert spark.sparkContext.getLocalProperty(resources.POOL) is None


class Cluster:
    """Stands for a session on a cluster, in the two settings that matter here."""

    def __init__(self, mode="FAIR"):
        self.sparkContext, self.master, self.mode = self, "spark://host:7077", mode

    def getConf(self):
        return {"spark.scheduler.mode": self.mode}


def test_fair_scheduling_gives_every_target_a_pool():
    assert resources.pool_of(Cluster(), "x", None) == "x" and resources.pool_of(Cluster(), "x", "p") == "p"
    assert resources.pool_of(Cluster("FIFO"), "x", None) is None


def test_profiles(spark):
    asked = resources.profile(Cluster(), {"cores": 4, "memory": "8g", "task_cpus": 2})
    assert asked.taskResources["cpus"].amount == 2
    assert (asked.executorResources["cores"].amount, asked.executorResources["memory"].amount) == (4, 8192)
    assert not resources.profile(Cluster(), {"task_cpus": 2}).executorResources
    assert resources.profile(Cluster(), {}) is None
    with pytest.raises(ValueError, match="unknown resources: gpus"):
        resources.profile(Cluster(), {"gpus": 1})
    with pytest.warns(UserWarning, match="local session"):
        assert resources.profile(spark, {"cores": 4}) is None


@pytest.mark.filterwarnings("ignore:a local session")
def test_branches_with_resources_in_a_local_session(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    plan = Plan(n="SELECT id FROM range(3)", sq=Target(lambda n: int(n["id"][0]) ** 2, dynamic=dynamic_map("n", each="y long"), resources={"task_cpus": 2}))
    Engine(plan, store).make()
    assert sorted(r["y"] for r in store.read("sq").collect()) == [0, 1, 4]


def test_whole_groups_over_batches():
    rows = pd.DataFrame({"k": list("aabbbc"), "o": [1, 1, 1, 1, 2, 1], "v": range(6)})
    total = resources.whole_groups(lambda g: pd.DataFrame({"k": [g["k"][0]], "s": [g["v"].sum()], "n": [len(g)]}), ["k", "o"])
    for cuts in ([], [1], [2], [1, 2, 3, 4, 5], [3, 3, 5]):
        edges = [0, *cuts, 6]
        batches = [rows.iloc[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        assert pd.concat(total(iter(batches))).to_numpy().tolist() == [["a", 1, 2], ["b", 5, 2], ["b", 4, 1], ["c", 5, 1]]
    assert list(total(iter([]))) == []


SCRIPT = '''
"""Two numbers and what comes of them."""
import math

def half(x):
    return x / 2

rows = "SELECT id FROM range(10)"
n = rows.count()
root = math.sqrt(half(n) + k)
both = [n, root]
'''


def test_script_with_commands(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    plan = code_to_plan(SCRIPT, {"k": 4})
    assert Engine(plan, store).make().built == ["rows", "n", "root", "both"]
    assert store.read("both") == [10, 3.0]
    assert Engine(code_to_plan(SCRIPT, {"k": 4}), store).make().built == []
    assert Engine(code_to_plan(SCRIPT.replace("x / 2", "x * 2.5"), {"k": 0}), store).outdated() == ["both", "root"]


def test_code_of_a_plan_is_a_script_again(spark, tmp_path):
    def both(a, b):
        return a + b

    plan = Plan(a=lambda: 1, b=lambda a: a + 1)
    text = plan_to_code(Plan(a=lambda: 1, c=both, b=lambda a: a), ["c"])
    assert text == "c = both(a, b)\n"
    again = code_to_plan("a = 1\nb = a + 1\n" + text, {"both": both})
    store = Store(spark, str(tmp_path / "store"))
    Engine(again, store).make()
    assert store.read("c") == 3 and len(plan) == 2


@pytest.mark.parametrize("text", ["for x in y: pass", "a = 1\na = 2"])
def test_scripts_that_are_no_plans(text):
    with pytest.raises(ValueError):
        code_to_plan(text)
