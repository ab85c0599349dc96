"""Branches of dynamic targets: what invalidates them, what they are made over, and their resumption, failures, recovery, seeds and files."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivulet.functions.draws import normal, uniform
from rivulet.functions.fingerprint import row_fingerprint
from rivulet.plans.deps import file_in
from rivulet.plans.engine import Engine, Failed
from rivulet.plans.plan import Plan, Target, Trigger, dynamic_cross, dynamic_group, dynamic_map
from rivulet.sources.hashing import hash_files
from rivulet.sources.store import Locked, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def table(*values):
    return lambda ctx: ctx.spark.createDataFrame([(v,) for v in values], "v int")


def scaled(xs, k):
    return xs.withColumn("y", F.col("v") * k)


def ys(store, target="y", column="y"):
    return store.values(target, column)


def make(store, plan, **options):
    return Engine(plan, store).make(**options)


# what invalidates branches


def test_a_changed_static_dependency_rebuilds_all_branches(store):
    def plan(k, *values):
        return Plan(xs=table(*values), k=Target(lambda n: n, bindings={"n": k}), y=Target(scaled, dynamic=dynamic_map("xs")))

    make(store, plan(10, 1, 2, 3))
    assert ys(store) == [10, 20, 30]
    assert make(store, plan(100, 1, 2, 3)).branches == {"y": 3}
    assert ys(store) == [100, 200, 300]
    assert make(store, plan(100, 1, 3, 5)).branches == {"y": 1}  # a changed element rebuilds alone
    assert ys(store) == [100, 300, 500]
    assert Engine(plan(100, 1, 3, 5), store).outdated() == []


def test_a_changed_helper_rebuilds_all_branches(store):
    def plan(helper):
        def command(xs):
            return xs.withColumn("y", helper(F.col("v")))

        return Plan(xs=table(1, 2), y=Target(command, dynamic=dynamic_map("xs")))

    def double(c):
        return c * 2

    def triple(c):
        return c * 3

    make(store, plan(double))
    assert make(store, plan(triple)).branches == {"y": 2}
    assert ys(store) == [3, 6]


def test_change_and_condition_rebuild_all_branches(store):
    factor = [2]

    def command(xs):
        return xs.withColumn("y", F.col("v") * factor[0])

    def plan(**trigger):
        return Plan(xs=table(1, 2), y=Target(command, dynamic=dynamic_map("xs"), trigger=Trigger(depend=False, **trigger)))

    version = [1]
    make(store, plan(change=lambda: version[0]))
    assert make(store, plan(change=lambda: version[0])).built == []
    version[0], factor[0] = 2, 5
    assert make(store, plan(change=lambda: version[0])).branches == {"y": 2}
    assert ys(store) == [5, 10]
    for mode in ("whitelist", "condition"):
        factor[0] += 1
        assert make(store, plan(condition=True, mode=mode)).branches == {"y": 2}
        assert ys(store) == [factor[0], 2 * factor[0]]
    assert make(store, plan(mode="condition")).built == []


def test_a_changed_input_file_rebuilds_all_branches(store, tmp_path):
    path = tmp_path / "factor.txt"
    code = f"from pyspark.sql import functions as F\nfrom rivulet.plans.deps import file_in\ndef command(xs):\n    return xs.withColumn('y', F.col('v') * int(open(file_in({str(path)!r})).read()))\n"
    (tmp_path / "branch_file_code.py").write_text(code)
    import importlib.util

    spec = importlib.util.spec_from_file_location("branch_file_code", tmp_path / "branch_file_code.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    plan = Plan(xs=table(1, 2), y=Target(module.command, dynamic=dynamic_map("xs")))
    path.write_text("2")
    make(store, plan)
    path.write_text("7")
    assert make(store, plan).branches == {"y": 2}
    assert ys(store) == [7, 14]
    assert file_in("x") == "x"


def test_force_builds_every_branch_and_max_expand_only_the_new_ones(store):
    def plan(k):
        return Plan(xs=table(1, 2, 3, 4), y=Target("SELECT *, v AS y FROM xs", dynamic=dynamic_map("xs"), max_expand=k))

    assert make(store, plan(2)).branches == {"y": 2}
    assert make(store, plan(4)).branches == {"y": 2}
    assert make(store, plan(3)).branches == {"y": 0}
    assert ys(store) == [1, 2, 3]
    assert make(store, plan(3), force=True).branches == {"y": 3}


# what is branched over


def pairs(u, w=None):
    return u


def test_group_over_cross_over_map(store):
    """16 branches of a cross, grouped by four; a group holds four consecutive branches."""
    plan = Plan(
        u=lambda ctx: ctx.spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "u int"),
        w=lambda ctx: ctx.spark.createDataFrame([(c,) for c in "abcd"], "w string"),
        x=Target("SELECT _branch_key, _occurrence, u, u * 10 AS x FROM u", dynamic=dynamic_map("u")),
        y=Target("SELECT _branch_key, _occurrence, u, concat(u, w) AS y FROM x", dynamic=dynamic_cross("x", "w")),
        z=Target(lambda y: y.groupBy("_branch_key", "_occurrence").agg(F.concat_ws(",", F.array_sort(F.collect_list("y"))).alias("z")), dynamic=dynamic_group("y", by="u")),
        m=Target("SELECT *, upper(z) AS m FROM z", dynamic=dynamic_map("z")),
    )
    assert make(store, plan).branches == {"x": 4, "y": 16, "z": 4, "m": 4}
    assert ys(store, "z", "z") == [",".join(f"{i}{c}" for c in "abcd") for i in (1, 2, 3, 4)]
    assert ys(store, "m", "m")[3] == "4A,4B,4C,4D"
    assert ys(store)[4 * 1 + 2] == "2c"  # branch k = 4 (i - 1) + j
    assert make(store, plan).built == []


def test_a_branch_of_several_rows_is_one_element(store):
    def spread(xs):
        return xs.select("_branch_key", "_occurrence", "v", F.explode(F.sequence(F.lit(1), F.col("v"))).alias("i"))

    def total(y):
        return y.groupBy("_branch_key", "_occurrence").agg(F.sum("i").alias("s"), F.count("*").alias("n"))

    def plan(*values):
        return Plan(xs=table(*values), y=Target(spread, dynamic=dynamic_map("xs")), t=Target(total, dynamic=dynamic_map("y")), both=Target(total, dynamic=dynamic_group("y")))

    assert make(store, plan(3, 1, 4)).branches == {"y": 3, "t": 3, "both": 1}
    assert ys(store, "t", "s") == [1, 6, 10] and ys(store, "both", "n") == [8]
    assert make(store, plan(3, 2, 4)).branches == {"y": 1, "t": 1, "both": 1}
    assert ys(store, "t", "s") == [3, 6, 10]
    twice = Plan(xs=table(3, 1), y=Target(spread, dynamic=dynamic_map("xs")), z=Target("SELECT v AS zv, i AS zi, _branch_key, _occurrence FROM y", dynamic=dynamic_map("y")), bad=Target(total, dynamic=dynamic_map("y", "z")))
    with pytest.raises(Failed, match="several rows"):
        make(store, twice)


def test_plain_values_and_nested_columns(store):
    squared = "SELECT *, {0} * {0} AS y FROM {0}"
    assert make(store, Plan(n=lambda: [3, 1, 2], y=Target(squared.format("n"), dynamic=dynamic_map("n")))).branches == {"y": 3}
    assert ys(store) == [9, 1, 4]
    assert make(store, Plan(n=lambda: [3, 5, 2], y=Target(squared.format("n"), dynamic=dynamic_map("n")))).branches == {"y": 1}
    plan = Plan(d=lambda: {"b": 1, "a": 2}, k=lambda: 10, two=lambda: ("x", "y"), y=Target("SELECT *, concat(d_key, d, two) AS y FROM d", dynamic=dynamic_map("d", "two")), s=Target("SELECT *, k + 1 AS y FROM k", dynamic=dynamic_map("k")))
    make(store, plan)
    assert ys(store) == ["b1x", "a2y"] and ys(store, "s") == [11]
    nested = Plan(rows=lambda ctx: ctx.spark.createDataFrame([(1, ["a", "b"]), (0, ["c"]), (2, [])], "i int, items array<string>"), y=Target("SELECT *, concat(i, items) AS y FROM rows", dynamic=dynamic_map("rows", explode="items")))
    assert make(store, nested).branches == {"y": 3}
    assert ys(store) == ["0c", "1a", "1b"]
    frame = Plan(f=lambda: pd.DataFrame({"a": [1, 2], "b": ["x", "y"]}), y=Target("SELECT *, concat(a, b) AS y FROM f", dynamic=dynamic_map("f")))
    make(store, frame)
    assert ys(store) == ["1x", "2y"]
    with pytest.raises(Failed, match="nothing to branch over"):
        make(store, Plan(e=lambda: [], y=Target("SELECT * FROM e", dynamic=dynamic_map("e"))))
    with pytest.raises(Failed, match="one type"):
        make(store, Plan(e=lambda: [1, object()], y=Target("SELECT * FROM e", dynamic=dynamic_map("e"))))
    with pytest.raises(Failed, match="have the column v"):
        make(store, Plan(a=table(1), b=table(2), y=Target("SELECT * FROM a", dynamic=dynamic_map("a", "b"))))


def test_fingerprints_tell_unlike_rows_apart(spark):
    rows = spark.createDataFrame([("a|+b", "c"), ("a", "b|+c"), ("a|1:b", None), ("a", "1:b|-"), (None, "-"), ("-", None)], "x string, y string")
    assert rows.select(row_fingerprint("x", "y").alias("f")).distinct().count() == 6


# resumption, failures, recovery


class Notes:
    """What commands leave behind for a test; unlike a list, not part of their fingerprints."""

    def __init__(self, fatal=0):
        self.sizes, self.fatal = [], fatal

    def add(self, n):
        self.sizes.append(n)
        if len(self.sizes) == self.fatal:
            raise Killed


class Killed(BaseException):
    """Ends a run as a lost driver would: nothing after it is executed."""


def test_an_interrupted_build_goes_on(store):
    notes = Notes(fatal=3)

    def command(xs):
        notes.add(xs.count())
        return xs.withColumn("y", F.col("v") + 1)

    plan = Plan(xs=table(*range(40)), y=Target(command, dynamic=dynamic_map("xs"), ranges=4))
    with pytest.raises(Killed):
        make(store, plan)
    assert "y" not in store.cached()
    before, notes.fatal = sum(notes.sizes[:2]), 0
    report = make(store, plan)
    assert report.branches == {"y": 40 - before} and 0 < before < 40
    assert ys(store) == [v + 1 for v in range(40)]
    assert store.files.names(f"{store.path}/partial/y") == []
    assert make(store, plan).built == []


def test_committed_ranges_of_other_code_are_not_taken_over(store):
    def plan(k, notes):
        def command(xs):
            notes.add(1)
            return xs.withColumn("y", F.col("v") * k)

        return Plan(xs=table(*range(20)), y=Target(command, dynamic=dynamic_map("xs"), ranges=3))

    with pytest.raises(Killed):
        make(store, plan(2, Notes(fatal=2)))
    assert make(store, plan(3, Notes())).branches == {"y": 20}
    assert ys(store) == [3 * v for v in range(20)]


def test_one_failing_branch_spoils_no_other(store):
    def inverse(pdf, base):
        if base[0] == pdf["v"][0]:
            raise ZeroDivisionError(f"no inverse of {pdf['v'][0]}")
        return pdf.assign(y=pdf["v"] * 2)[["y"]]

    def plan(bad, *extra):
        return Plan(xs=table(*range(100), *extra), y=Target(inverse, dynamic=dynamic_map("xs", each="y long"), bindings={"base": [bad]}, trigger=Trigger(command=True)))

    with pytest.raises(Failed, match="1 of 100 branches failed; branch 8: ZeroDivisionError: no inverse of 7"):
        make(store, plan(7))
    errors = store.branch_errors("y").collect()
    assert [(r["_branch"], "no inverse of 7" in r["error"]) for r in errors] == [(8, True)]
    report = make(store, plan(7), keep_going=True)
    assert report.branches == {"y": 1} and report.failed == ["y"]


def test_the_next_make_builds_the_failed_branch_alone(store, tmp_path):
    flag = tmp_path / "flag"
    flag.write_text("")

    def flaky(pdf, seed):
        from pathlib import Path

        if pdf["v"][0] == 7 and Path(pdf["at"][0]).exists():
            raise RuntimeError("not yet")
        return [(int(pdf["v"][0]) * 2, seed)]

    def rows(*values):
        return lambda ctx: ctx.spark.createDataFrame([(v, str(flag)) for v in values], "v int, at string")

    def plan(*values):
        return Plan(xs=rows(*values), y=Target(flaky, dynamic=dynamic_map("xs", each="y long, seed long"), ranges=2), n="SELECT count(*) AS n FROM y")

    with pytest.raises(Failed, match="not yet"):
        make(store, plan(*range(100)))
    assert "n" not in store.cached()
    flag.unlink()
    assert make(store, plan(*range(100))).branches == {"y": 1}
    assert ys(store) == [2 * v for v in range(100)] and store.read("n").first()["n"] == 100
    flag.write_text("")
    with pytest.raises(Failed, match="1 of 1 branches failed"):
        make(store, plan(*range(100), 7))
    flag.unlink()
    assert make(store, plan(*range(100), 7)).branches == {"y": 1}  # what there was before the failure is kept
    assert sorted(ys(store)) == sorted([2 * v for v in range(100)] + [14])


def test_branches_without_rows_count_as_built(store):
    def odd(pdf):
        return pdf[pdf["v"] % 2 == 1].rename(columns={"v": "y"})

    plan = Plan(xs=table(1, 2, 3), y=Target(odd, dynamic=dynamic_map("xs", each="y int")))
    assert make(store, plan).branches == {"y": 3}
    assert ys(store) == [1, 3]
    more = Plan(xs=table(1, 2, 3, 5), y=Target(odd, dynamic=dynamic_map("xs", each="y int")))
    assert make(store, more).branches == {"y": 1}


def test_a_command_for_each_branch_takes_no_tables(store):
    def command(pdf, other):
        return pdf

    with pytest.raises(Failed, match="cannot take other"):
        make(store, Plan(xs=table(1), other=table(2), y=Target(command, dynamic=dynamic_map("xs", each="v int"))))


def test_single_branches_are_recovered(store):
    notes = Notes()

    def command(xs):
        notes.add(xs.count())
        return xs.withColumn("y", F.col("v") * 2)

    def plan(*values):
        return Plan(xs=table(*values), y=Target(command, dynamic=dynamic_map("xs")))

    make(store, plan(1, 2, 3))
    make(store, plan(1, 20, 30))
    assert notes.sizes == [3, 2]
    assert make(store, plan(10, 2, 3), recover=True).branches == {"y": 1}  # 2 and 3 are of the first build
    assert ys(store) == [4, 6, 20]
    assert make(store, plan(1, 20, 3), recover=True).branches == {"y": 0}  # of both
    assert ys(store) == [2, 6, 40] and sum(notes.sizes) == 6
    store.clean("y")
    assert make(store, plan(30, 10, 2), recover=True).branches == {"y": 0}
    assert ys(store) == [4, 20, 60]
    store.clean(garbage_collection=True)
    assert make(store, plan(30, 10, 2), recover=True).branches == {"y": 3}  # objects that are gone cannot be


# seeds


def test_draws_depend_on_the_branch_alone(store, spark):
    def command(xs):
        return xs.withColumn("y", uniform("_seed", "v")).withColumn("z", normal("_seed", "v"))

    def plan(partitions, *values):
        return Plan(xs=lambda ctx: ctx.spark.createDataFrame([(v,) for v in values], "v int").repartition(partitions), y=Target(command, dynamic=dynamic_map("xs")))

    make(store, plan(1, 1, 2, 3))
    first = ys(store)
    make(store, plan(7, 3, 9, 2, 1), force=True)
    again = dict(zip((1, 2, 3, 9), ys(store), strict=True))
    assert [again[v] for v in (1, 2, 3)] == first and len(set(again.values())) == 4
    assert Engine(plan(1, 1, 2), store, seed=0).make().branches == {"y": 0}
    reseeded = Plan(xs=table(1, 2), y=Target(command, dynamic=dynamic_map("xs"), seed=99))
    assert make(store, reseeded).branches == {"y": 2} and ys(store)[0] != first[0]
    draws = spark.range(20_000).select(uniform(F.lit(5), "id").alias("u"), normal(F.lit(5), "id").alias("n")).agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("n"), F.stddev("n")).first()
    assert abs(draws[0] - 0.5) < 0.01 and 0 <= draws[1] < draws[2] < 1 and abs(draws[3]) < 0.03 and abs(draws[4] - 1) < 0.03


# files


def test_one_changed_file_rebuilds_one_branch(store, tmp_path):
    def write(pdf):
        from pathlib import Path

        at = Path(pdf["folder"][0]) / f"{pdf['v'][0]}.txt"
        at.write_text(f"made {pdf['v'][0]}")
        return [str(at)]

    plan = Plan(xs=lambda ctx: ctx.spark.createDataFrame([(v, str(tmp_path)) for v in range(6)], "v int, folder string"), y=Target(write, dynamic=dynamic_map("xs", each="path string"), format="file"))
    assert make(store, plan).branches == {"y": 6}
    assert make(store, plan).built == []
    (tmp_path / "3.txt").write_text("edit 3")  # of equal size
    assert Engine(plan, store).reasons(plan["y"]) == ["file"]
    assert make(store, plan).branches == {"y": 1}
    assert (tmp_path / "3.txt").read_text() == "made 3"
    (tmp_path / "5.txt").unlink()
    assert make(store, plan).branches == {"y": 1} and (tmp_path / "5.txt").exists()
    (tmp_path / "1.txt").touch()
    assert Engine(plan, store).outdated() == []


def test_static_files_are_hashed_by_content(store, tmp_path):
    path = tmp_path / "large.bin"
    path.write_bytes(b"x" * 300_000)
    first = store.files.fingerprint(str(path))
    path.touch()
    assert store.files.fingerprint(str(path)) == first
    path.write_bytes(b"x" * 299_999 + b"y")
    second = store.files.fingerprint(str(path))
    assert second != first
    assert store.files._hash(str(path), 300_000) == hash_files(store.spark, [(str(path), 300_000)])[str(path)]
    folder = tmp_path / "folder"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "a").write_text("1")
    (folder / "b").write_text("2")
    before = store.files.fingerprint(str(folder))
    (folder / "b").rename(folder / "c")
    assert store.files.fingerprint(str(folder)) != before
    assert store.files.fingerprint(str(tmp_path / "none")) is None


def test_urls_are_told_apart_by_their_tags(store):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    tag = ["one"]

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200 if self.path == "/x" else 404)
            self.send_header("ETag", tag[0])
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    first = store.files.fingerprint(url)
    assert first and store.files.fingerprint(url) == first
    tag[0] = "two"
    assert store.files.fingerprint(url) != first
    assert store.files.fingerprint(url.replace("/x", "/gone")) is None
    server.shutdown()


def test_gc_waits_for_a_run_and_plans_tell_what_is_stored(store):
    make(store, Plan(a=lambda: 1, b=lambda: 2))
    plan = Plan(a=lambda: 1, c=lambda: 3)
    assert store.cached_planned(plan) == ["a"] and store.cached_unplanned(plan) == ["b"]
    store.lock()
    with pytest.raises(Locked):
        store.gc()
    store.unlock()
    store.clean("b")
    assert len(store.gc()) == 1 and store.read("a") == 1
