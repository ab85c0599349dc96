"""Code that commands reach through classes, dispatch, partials and decorators."""

from __future__ import annotations

import functools
import importlib.util

import pytest

from rivulet.plans import deps as d
from rivulet.plans.plan import Plan, Target

MODULE = '''
import functools

class Base:
    limit = 3
    def inherited(self): return 1
    @property
    def size(self): return 4
    @staticmethod
    def fixed(): return 5
    def itself(self): return Base

class Tool(Base):
    def work(self): return helper()

def helper(): return 7

@functools.singledispatch
def shown(x): return 8

@shown.register
def _(x: int): return 9

@functools.lru_cache
def cached(): return 10

def plain(x, y): return 11
part = functools.partial(plain, y=12)
tool = Tool()

def by_class(): return Tool().work()
def by_instance(): return tool.work()
def by_dispatch(): return shown(1)
def by_cache(): return cached()
def by_partial(): return part(1)
def by_nothing(): return 0
'''


@pytest.fixture
def load(tmp_path):
    n = iter(range(1000))

    def loaded(old="", new=""):
        assert old in MODULE
        path = tmp_path / f"code_{next(n)}.py"
        path.write_text(MODULE.replace(old, new) if old else MODULE)
        spec = importlib.util.spec_from_file_location("project_code", path)
        module = importlib.util.module_from_spec(spec)
        import sys

        sys.modules["project_code"] = module
        spec.loader.exec_module(module)
        return module

    return loaded


@pytest.mark.parametrize(
    ("command", "edits", "others"),
    [
        ("by_class", ["return 1", "return 4", "return 5", "limit = 3", "return 7", "return helper()"], ["return 8", "return 11"]),
        ("by_instance", ["return 1", "return 7"], ["return 9"]),
        ("by_dispatch", ["return 8", "return 9"], ["return 7"]),
        ("by_cache", ["return 10"], ["return 9"]),
        ("by_partial", ["return 11", "y=12"], ["return 10"]),
        ("by_nothing", [], ["return 1", "return 10", "y=12"]),
    ],
)
def test_edits_are_seen(load, command, edits, others):
    of = lambda module: d.function_fingerprint(getattr(module, command))
    before = of(load())
    assert of(load()) == before
    for old in edits:
        assert of(load(old, f"{old} + 1")) != before, old
    for old in others:
        assert of(load(old, f"{old} + 1")) == before, old


def test_a_command_that_uses_only_a_class_depends_on_it(load):
    module = load()
    assert d.dependencies(Target(module.by_class, name="x"), {"x"})["functions"] == {"Tool"}
    assert d.dependencies(Target(module.by_nothing, name="x"), {"x"})["functions"] == set()
    assert len(Plan(a=module.by_class)) == 1
    assert not d.tracked_code(functools) and not d.tracked_code(3) and d.tracked_code(module.tool)


def test_history_has_a_column_for_each_named_literal(spark, tmp_path, load):
    from rivulet.plans.engine import Engine
    from rivulet.plans.plan import map_
    from rivulet.sources.store import Store

    (tmp_path / "trained.py").write_text("def fit(rate, rounds=3, seed=1, name=None): return rate * rounds\ndef small(): return fit(rate=0.5, rounds=-2, name='x')\ndef large(): return fit(rate=8, seed=5)\ndef bound(depth): return depth\n")
    spec = importlib.util.spec_from_file_location("trained", tmp_path / "trained.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    store = Store(spark, str(tmp_path / "store"))
    Engine(Plan(a=module.small, b=module.large, c=Target(module.bound, map_(depth=[4]))), store).make()
    got = {r["target"]: r.asDict() for r in store.history(analyze=True).collect()}
    assert [got["a"][k] for k in ("rate", "rounds", "name", "depth", "seed_argument")] == ["0.5", "-2", "x", None, None]
    assert [got["b"][k] for k in ("rate", "rounds", "seed_argument")] == ["8", None, "5"]
    assert got["c_4"]["depth"] == "4"
    assert "rate" not in store.history().columns
