"""Every format gives back what was written, and SQL commands are read as Spark's parser reads them."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest

from rivulet.plans.engine import Engine
from rivulet.plans.plan import Plan, Target, map_
from rivulet.plans.relations import relations, with_frames
from rivulet.sources.store import Store

ROWS = [
    ("", 1, 0.1, None, b"\x00\xff", [1, None], {"k": ""}, datetime.datetime(2020, 1, 2, 3, 4, 5, 678901), Decimal("1.50")),
    (None, 2, float("inf"), True, None, None, None, None, None),
    ('a"b\n,c', 3, 1e-300, False, b"", [], {}, datetime.datetime(1999, 12, 31), Decimal("-0.01")),
    ("\\N", 4, -0.0, None, b"x", [2], {"a": None}, None, None),
    ("\\\\N", None, None, None, None, None, None, None, None),
    ("null\r\nx", 5, 2.5, True, b"\n", [3], {"a,b": '"'}, None, None),
    (" padded \t", 6, 7.0, True, b" ", [4], {"": "\\"}, None, None),
    ("日本 😀 é", 7, 7.0, True, b" ", [4], {"": "\\"}, None, None),
]
SCHEMA = "s string, i int, d double, b boolean, x binary, a array<int>, m map<string,string>, t timestamp, n decimal(10,2)"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.mark.parametrize("format_", ["parquet", "orc", "csv", "json"])
def test_round_trip(store, spark, format_):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = store.get(store.write(rows, format_))
    assert got.schema.simpleString() == rows.schema.simpleString()
    key = lambda r: repr((r["i"], r["s"]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert sorted(map(key, got.collect())) == sorted(map(key, rows.collect()))
    assert store.write(got, format_) == store.write(rows.repartition(3), format_)


def test_relations(spark):
    names = lambda sql: [sql[a:b] for _, a, b in relations(sql)]
    assert names("SELECT extract(year FROM d), a, u FROM u AS v JOIN w ON v.x IS DISTINCT FROM y") == ["u", "w"]
    assert names("WITH q(x) AS (SELECT * FROM q), r AS (SELECT * FROM q) SELECT * FROM r, q") == ["q"]
    assert names("SELECT * FROM t WHERE x IN (SELECT y FROM `my.t`) AND EXISTS (SELECT 1 FROM e) -- from z") == ["t", "`my.t`", "e"]
    assert names("SELECT '日本 from x' AS a FROM b TABLESAMPLE (1 ROWS) LATERAL VIEW explode(c) d AS f") == ["b"]
    assert names("FROM a |> JOIN b ON a.x = b.x |> SELECT x") == ["a", "b"]
    assert names("not a query at all FROM a, b JOIN c 'from d'") == ["a", "b", "c"]
    assert with_frames("SELECT '{x}', v FROM v, (SELECT 1 FROM w) -- {", {"v": "f0"}) == "SELECT '{{x}}', v FROM {f0}, (SELECT 1 FROM w) -- {{"


def test_columns_named_like_targets(store):
    plan = Plan(u="SELECT 1 AS u, 2 AS year, date'2020-05-01' AS d", year="SELECT 7 AS x", out="SELECT year, u, extract(year FROM d) AS y, '{u} from year' AS s FROM u WHERE u IS NOT DISTINCT FROM 1")
    engine = Engine(plan, store)
    assert engine.deps["out"]["targets"] == {"u"}
    engine.make()
    assert tuple(store.read("out").first()) == (2, 1, 2020, "{u} from year")


def test_words_in_strings_stay(spark):
    plan = Plan(raw="SELECT 1 AS year", part=Target("""SELECT 'my year x' AS a, "year" AS b, raw.year AS c, year AS d FROM raw""", map_(year=[1])))
    assert plan["part_1"].command == """SELECT 'my year x' AS a, "year" AS b, raw.year AS c, 1 AS d FROM raw"""
