"""Dynamic targets: what their branches are, which are kept, and how the others are built, committed and recovered.

A branch is known by its content and its occurrence (``_branch_key``, ``_occurrence``),
not by its position. Results of branches come from up to three places: the target's last
result, what an interrupted or partly failed build had committed, and, if asked for,
any earlier build with the same code and inputs. Only the rest is built.

A build goes in ranges of hashes of ``_branch_key``. The outcome of each range is
written and then marked; a later build with the same code and inputs takes
marked ranges over, however its own ranges are cut.
"""

from __future__ import annotations

import json
import traceback
import uuid
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rivulet.functions.fingerprint import row_fingerprint, rows_fingerprint
from rivulet.operators import branching as b
from rivulet.plans import deps as d
from rivulet.plans import resources
from rivulet.plans.plan import Target
from rivulet.sources import hashing
from rivulet.sources.scratch import materialise

if TYPE_CHECKING:
    from rivulet.plans.engine import Engine, Report

IDENTITY = ["_branch_key", "_occurrence"]
#: Columns that the engine adds to the rows a command gets.
OWN = (*IDENTITY, "_branch", "_seed")
#: A parameter that nothing in the plan is bound to; its default holds.
UNBOUND = object()
DONE, FAILED, ROW = "done", "failed", "row"


class BranchesFailed(RuntimeError):
    """Some branches of a target failed; ``errors`` names the stored table of them."""

    def __init__(self, message: str, errors: str):
        super().__init__(message)
        self.errors = errors


class Elements:
    """What a target is branched over: rows with ``_at``, the number of their element. Of another dynamic target's branches each is one element."""

    def __init__(self, rows: DataFrame, n: int, several: bool):
        self.rows, self.n, self.several = rows, n, several
        self.columns = [c for c in rows.columns if c != "_at"]

    def has_several_rows(self) -> bool:
        return self.several and not self.rows.groupBy("_at").count().where("count > 1").isEmpty()


def zip_order(rows: DataFrame, first: str) -> list[str]:
    """Rows are in the order of a column, those equal in it in that of the others that have one."""
    return [first, *(c for c, kind in rows.dtypes if c != first and "map<" not in kind)]


def _plain(value: Any, name: str, spark) -> DataFrame:
    """Elements of a value that is no table: of a list, tuple, array or series its items, of a dictionary its entries, else the value itself."""
    if isinstance(value, pd.DataFrame):
        return spark.createDataFrame(value.assign(_at=range(1, len(value) + 1)))
    if isinstance(value, dict):
        rows = [(i + 1, k, v) for i, (k, v) in enumerate(value.items())]
        columns = ["_at", f"{name}_key", name]
    else:
        items = value.tolist() if hasattr(value, "tolist") else list(value) if isinstance(value, (list, tuple, range, set, frozenset)) else [value]
        items = sorted(items, key=repr) if isinstance(value, (set, frozenset)) else [items] if not isinstance(items, list) else items
        rows, columns = [(i + 1, x) for i, x in enumerate(items)], ["_at", name]
    if not rows:
        raise ValueError(f"{name}: nothing to branch over")
    try:
        return spark.createDataFrame(rows, columns)
    except Exception as e:
        raise TypeError(f"{name}: its items are not of one type that a table can hold") from e


def elements(engine: Engine, t: Target, name: str, order: str | None, explode: str | None) -> Elements:
    value = engine._value(name, t)
    if not isinstance(value, DataFrame):
        rows = _plain(value, name, engine.spark).withColumn("_at", F.col("_at").cast("bigint"))
        return Elements(rows, rows.count(), False)
    if name in engine.plan.targets and engine.plan[name].dynamic and "_branch" in value.columns:
        rows = value.drop(*IDENTITY).withColumnRenamed("_branch", "_at")
        return Elements(rows, engine._meta(name)["branches"], True)
    rows = b.with_ordinal(value, *zip_order(value, order or value.columns[0]), out="_at")
    if explode and explode in value.columns:
        if dict(value.dtypes)[explode].startswith("map<"):
            rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != explode], F.posexplode(F.array_sort(F.map_entries(explode))).alias("_pos", explode))
        else:
            rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != explode], F.posexplode(explode).alias("_pos", explode))
        rows = b.with_ordinal(rows.withColumnRenamed("_at", "_row"), "_row", "_pos", out="_at").select("_at", *[F.col(f"`{c}`") for c in value.columns])
    return Elements(rows, rows.count(), False)


def _distinct_columns(t: Target, inputs: list[Elements]) -> list[str]:
    columns: list[str] = []
    for x in inputs:
        if twice := [c for c in x.columns if c in columns]:
            raise ValueError(f"{t.name}: several inputs have the column {', '.join(twice)}; rename it in one of them")
        columns += x.columns
    return columns


def branch_rows(engine: Engine, t: Target) -> DataFrame:
    """Rows of the grouping variables with _branch, _branch_key, _occurrence and _seed."""
    dyn = t.dynamic
    order = {n: dyn.order[i] if i < len(dyn.order) else None for i, n in enumerate(dyn.names)}
    inputs = [elements(engine, t, n, order[n], dyn.explode) for n in dyn.names]
    columns = _distinct_columns(t, inputs)
    if dyn.kind != "cross" and sum(x.has_several_rows() for x in inputs) > 1:
        raise ValueError(f"{t.name}: only one input may have branches of several rows")
    if dyn.kind == "cross":
        out = inputs[0].rows.withColumnRenamed("_at", "_branch")
        for x in inputs[1:]:  # the combinations that were asked for
            both = out.crossJoin(x.rows)
            out = both.withColumn("_branch", (F.col("_branch") - 1) * x.n + F.col("_at")).drop("_at")
    else:
        if any(x.n != inputs[0].n for x in inputs):
            raise ValueError(f"{t.name}: inputs of different sizes, the first has {inputs[0].n} rows")
        out = inputs[0].rows
        for x in inputs[1:]:
            out = out.join(x.rows, "_at")
        out = _grouped(engine, t, out, columns, inputs[0].n) if dyn.kind == "group" else out.withColumnRenamed("_at", "_branch")
    if dyn.kind != "group":
        if any(x.several for x in inputs):  # branches of any number of rows
            keys = out.groupBy("_branch").agg(rows_fingerprint(*columns).alias("_branch_key"))
            keys = keys.withColumn("_occurrence", F.row_number().over(Window.partitionBy("_branch_key").orderBy("_branch")).cast("bigint"))
            out = out.join(keys, "_branch")
        else:
            out = out.withColumn("_branch_key", row_fingerprint(*columns))
            out = out.withColumn("_occurrence", F.row_number().over(Window.partitionBy("_branch_key").orderBy("_branch")).cast("bigint"))
    out = b.max_expand(out, t.max_expand) if t.max_expand is not None else out
    # from the target's seed and the branch alone, so neither partitions nor other branches matter
    return out.withColumn("_seed", F.xxhash64(F.lit(engine.target_seed(t)), *IDENTITY))


def _grouped(engine: Engine, t: Target, rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Groups in the order of their first elements."""
    key = t.dynamic.by
    if key and "." in key and key not in columns:
        other, _, key = key.partition(".")
        by = elements(engine, t, other, key if not engine.plan[other].dynamic and engine._value(other, t).columns[0] == key else None, None)
        if by.n != n:
            raise ValueError(f"{t.name}: inputs of different sizes, the first has {n} rows")
        rows = rows.join(by.rows.select("_at", F.col(f"`{key}`").alias("_by")).distinct(), "_at")
    else:
        rows = rows.withColumn("_by", F.col(f"`{key}`") if key else F.lit("all"))
    content = rows.groupBy("_by").agg(F.min("_at").alias("_first"), rows_fingerprint(*columns).alias("h"))
    numbered = b.with_ordinal(content, "_first", out="_branch").select(F.col("_by").alias("_group"), "_branch", F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("+"), F.col("_by").cast("string")), F.lit("-")), "h")).alias("_branch_key"), F.lit(1).cast("bigint").alias("_occurrence"))
    return rows.join(numbered, rows["_by"].eqNullSafe(numbered["_group"])).drop("_group", "_by", "_at")


class DynamicBuild:
    """One build of a dynamic target."""

    def __init__(self, engine: Engine, t: Target, state: dict[str, Any], last: dict | None, recover: bool):
        """``last`` is the record of the result whose branches may be kept: its hash and its manifest, and its errors if any."""
        self.engine, self.t, self.store, self.spark = engine, t, engine.store, engine.spark
        self.last, self.recover = last, recover
        #: Everything that decides a branch's result besides the branch itself.
        self.key = work_key(state)
        self.manifest_hash: str | None = None
        self.built = 0

    @property
    def folder(self) -> str:
        return f"{self.store.path}/partial/{self.t.name}/{self.key}"

    def result(self, report: Report) -> DataFrame:
        """All branches' rows with ``_branch``; raises ``BranchesFailed`` once the others are committed."""
        t = self.t
        rows = branch_rows(self.engine, t)
        if unknown := [c for c in t.dynamic.trace if c not in rows.columns]:
            raise ValueError(f"{t.name}: cannot trace {', '.join(unknown)}")
        manifest = rows.groupBy(*IDENTITY, "_branch").agg(*[F.min(c).alias(c) for c in t.dynamic.trace]) if t.dynamic.trace else rows.select(*IDENTITY, "_branch").distinct()
        self.manifest_hash = self.store.write(manifest)
        manifest = self.store.get(self.manifest_hash).select(*IDENTITY, "_branch")
        if (n := manifest.count()) == 0:
            raise ValueError(f"{t.name}: nothing to branch over")
        known = self._known(manifest)
        todo = rows if known is None else rows.join(known.select(*IDENTITY), IDENTITY, "left_anti")
        self.built = n - (0 if known is None else known.count())
        report.branches[t.name] = self.built
        parts = [] if known is None else self._rows_of(known)
        if self.built:
            if t.ranges == 1 and not t.dynamic.each:
                result = self._checked(self._command(todo))
                parts.append(result)
            else:
                parts += self._in_ranges(todo, manifest)
        out = b.bind(*[p.drop("_branch", "_seed") for p in parts])
        return out.join(manifest, IDENTITY)

    # what there is already

    def _known(self, manifest: DataFrame) -> DataFrame | None:
        """(_branch_key, _occurrence, _source) of the branches whose results exist, one source for each."""
        found = []
        if self.last and self.store.has(self.last["hash"]) and self.last.get("manifest") and self.store.has(self.last["manifest"]):
            found.append(self.store.get(self.last["manifest"]).select(*IDENTITY, F.lit(f"object:{self.last['hash']}").alias("_source")))
        for path in committed(self.store, self.folder):
            outcome = self.spark.read.parquet(f"{path}/outcome").where(F.col("_status") == DONE)
            found.append(outcome.select(*IDENTITY, F.lit(f"range:{path}").alias("_source")))
        index = f"{self.store.path}/branches/{self.t.name}/{self.key}"
        if self.recover and self.store.files.exists(index):
            entries = self.spark.read.schema("_branch_key string, _occurrence long, object string").parquet(f"{index}/*")
            stored = [r["object"] for r in entries.select("object").distinct().collect() if self.store.has(r["object"])]  # one for each build
            entries = entries.where(F.col("object").isin(stored))
            found.append(entries.select(*IDENTITY, F.concat(F.lit("object:"), "object").alias("_source")))
        if not found:
            return None
        every = b.bind(*found)
        if self.last and self.t.format == "file" and self.t.trigger.file and (gone := changed_branches(self.store, self.last)) is not None:
            every = every.join(gone, IDENTITY, "left_anti")
        one = every.groupBy(*IDENTITY).agg(F.min("_source").alias("_source"))
        return materialise(one.join(manifest.select(*IDENTITY), IDENTITY, "left_semi"), "known-branches")

    def _rows_of(self, known: DataFrame) -> list[DataFrame]:
        """The rows of known branches, a table for each source."""
        out = []
        for r in known.select("_source").distinct().orderBy("_source").collect():  # one for each build or range
            kind, _, at = r["_source"].partition(":")
            rows = self.store.get(at) if kind == "object" else _rows(self.spark.read.parquet(f"{at}/outcome"))
            out.append(rows.join(known.where(F.col("_source") == r["_source"]).select(*IDENTITY), IDENTITY, "left_semi"))
        return out

    # building

    def _command(self, rows: DataFrame) -> DataFrame:
        first = next((p for p in self.t.parameters() if p in self.t.dynamic.names), None)
        return self.engine._run(self.t, {first or self.t.dynamic.names[0]: rows})

    def _checked(self, result: DataFrame) -> DataFrame:
        if missing := [c for c in IDENTITY if c not in result.columns]:
            raise ValueError(f"{self.t.name}: the result lacks {', '.join(missing)}")
        return result

    def _in_ranges(self, todo: DataFrame, manifest: DataFrame) -> list[DataFrame]:
        n, run = self.t.ranges, uuid.uuid4().hex
        source = f"{self.folder}/input-{run}"
        todo.withColumn("_range", F.pmod(F.xxhash64("_branch_key"), F.lit(n)).cast("int")).write.partitionBy("_range").parquet(source)
        paths, errors = [], []
        for i in range(n):
            if not self.store.files.exists(f"{source}/_range={i}"):
                continue
            rows, path = self.spark.read.schema(todo.schema).parquet(f"{source}/_range={i}"), f"{self.folder}/run-{run}-{i}"
            outcome = self._each(rows) if self.t.dynamic.each else self._whole(rows)
            outcome.write.parquet(f"{path}/outcome")
            self.store.files.create(f"{path}/committed.json", json.dumps({"range": i, "of": n}))
            paths.append(path)
            self.engine._log(f"range {i + 1} of {n}", self.t.name)
        self.store.files.delete(source)
        outcomes = [self.spark.read.parquet(f"{p}/outcome") for p in paths]
        if self.t.dynamic.each:
            errors = b.bind(*[o.where(F.col("_status") == FAILED).select(*IDENTITY, F.col("_error").alias("error")) for o in outcomes]).join(manifest, IDENTITY)
            if failed := errors.count():
                first = errors.orderBy("_branch").first()
                raise BranchesFailed(f"{failed} of {self.built} branches failed; branch {first['_branch']}: {first['error']}", self.store.write(errors))
        return [_rows(o) for o in outcomes]

    def _whole(self, rows: DataFrame) -> DataFrame:
        """The outcome of a command over a table of branches: its rows, and for each branch a row that says that it is done."""
        done = rows.select(*IDENTITY).distinct().withColumn("_status", F.lit(DONE))
        return self._checked(self._command(rows)).drop("_branch", "_seed").withColumn("_status", F.lit(ROW)).unionByName(done, allowMissingColumns=True).withColumn("_error", F.lit(None).cast("string"))

    def _each(self, rows: DataFrame) -> DataFrame:
        """The outcome of a command that is run for each branch by itself, in the executors; a branch that raises spoils no other."""
        t, kept = self.t, [c for c in rows.columns if c not in OWN]
        wanted = StructType.fromDDL(t.dynamic.each)
        schema = StructType([*(rows.schema[c] for c in IDENTITY), StructField("_status", StringType()), StructField("_error", StringType()), *wanted.fields])
        args = {p: self.engine._argument(t, p) for p in t.parameters()[1:] if p not in ("seed", *t.dynamic.names)}
        args = {p: v for p, v in args.items() if v is not UNBOUND}
        if tables := [p for p, v in args.items() if p == "ctx" or isinstance(v, DataFrame)]:
            raise TypeError(f"{t.name}: a command that is run in the executors for each branch cannot take {', '.join(tables)}; join tables to what is branched over")
        f, names, seeded = t.command, list(schema.names), "seed" in t.parameters()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            identity = [pdf[c].iloc[0] for c in IDENTITY]
            try:
                own = args | ({"seed": int(pdf["_seed"].iloc[0])} if seeded else {})
                result = f(pdf[kept].reset_index(drop=True), **own)
                if not isinstance(result, pd.DataFrame):
                    result = pd.DataFrame([x if isinstance(x, tuple) else (x,) for x in (result if isinstance(result, list) else [result])], columns=wanted.names)
                out = result[wanted.names].copy()
                out["_status"], out["_error"] = ROW, None
                state, error = DONE, None
            except Exception as e:
                out, state, error = None, FAILED, "".join(traceback.format_exception_only(e)).strip()
            end = pd.DataFrame([[None] * len(names)], columns=names, dtype=object)
            end["_status"], end["_error"] = state, error
            out = end if out is None or out.empty else pd.concat([out.astype(object), end], ignore_index=True)
            out["_branch_key"], out["_occurrence"] = identity
            return out[names]

        if profile := resources.profile(self.spark, t.resources):
            dealt = rows.repartition(*IDENTITY).sortWithinPartitions(*IDENTITY)
            return dealt.mapInPandas(resources.whole_groups(run, list(IDENTITY)), schema, profile=profile)
        return rows.groupBy(*IDENTITY).applyInPandas(run, schema)

    # after the build

    def finished(self, hash_: str) -> dict[str, Any]:
        """What the metadata keep of a successful build; its branches are entered in the index, and its ranges go."""
        index = f"{self.store.path}/branches/{self.t.name}/{self.key}"
        if self.built or not self.store.files.exists(index):
            self.store.get(self.manifest_hash).select(*IDENTITY, F.lit(hash_).alias("object")).write.parquet(f"{index}/{uuid.uuid4().hex}")
        self.store.files.delete(f"{self.store.path}/partial/{self.t.name}")
        manifest = self.store.get(self.manifest_hash)
        out = {"manifest": self.manifest_hash, "branches": manifest.count()}
        result = self.store.get(hash_)
        if self.t.format == "file":
            if "path" not in result.columns:
                raise ValueError(f"{self.t.name}: branches of format file return rows with a path")
            files = hashing.watched(result.where("path IS NOT NULL"))
            out["branch_files"] = self.store.write(result.select("path", *IDENTITY).distinct().join(files, "path"))
        return out


def _rows(outcome: DataFrame) -> DataFrame:
    return outcome.where(F.col("_status") == ROW).drop("_status", "_error")


def committed(store, folder: str) -> list[str]:
    """Ranges of interrupted builds that were written as a whole."""
    return [f"{folder}/{n}" for n in store.files.names(folder) if n.startswith("run-") and store.files.exists(f"{folder}/{n}/committed.json")]


def work_key(state: dict[str, Any]) -> str:
    return d.digest(*[state[k] for k in ("command", "dependency_hash", "file_in", "seed", "format", "change")])


def changed_branches(store, meta: dict) -> DataFrame | None:
    """(_branch_key, _occurrence) of the branches one of whose files has another content than after the build, or has gone."""
    if not meta.get("branch_files") or not store.has(meta["branch_files"]):
        return None
    known = store.get(meta["branch_files"])
    paths = hashing.changed(known.select("path", "size", "mtime", "hash").distinct())
    return known.join(paths, "path", "left_semi").select(*IDENTITY).distinct()
