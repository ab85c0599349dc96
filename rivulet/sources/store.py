"""The store: results by content, and what is known about them by name.

::

    objects/<hash>/          a table, value.json for a plain value, or files.json for watched files
    memo/<key>.json          results of ``memo``
    meta/<target>.json       the latest metadata of a target
    progress/<target>.json   its latest status
    partial/<target>/<key>/  committed ranges of a build that has not ended
    branches/<target>/<key>/ which objects hold which branches, for their recovery
    files/<key>.json         sizes, times and hashes of watched files
    history/<time>-<id>.json one entry for each build, never changed
    recover/<key>.json       the metadata of the latest build with that recovery key
    session.json, lock

An object is written under another name first and moved when it is complete;
the metadata that names it come last. A crash leaves at most unnamed objects,
which ``gc`` removes.
"""

from __future__ import annotations

import base64
import json
import pickle
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructField, StructType

from rivulet.functions.fingerprint import table_fingerprint
from rivulet.plans.deps import digest
from rivulet.sources.files import Files

FORMATS = ("parquet", "orc", "json", "csv", "value", "file")
META = "target string, hash string, command string, dependency_hash string, file_hash string, seed long, format string, built double, elapsed double, error string, recovery_key string"


#: So that what is read is what was written: quotes, line ends, nulls and fields that are null.
OPTIONS = {
    "csv": {"header": True, "quoteAll": True, "quote": '"', "escape": '"', "multiLine": True, "emptyValue": "", "nullValue": "", "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False},
    "json": {"ignoreNullFields": False, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
}


def _as_csv(value: DataFrame) -> DataFrame:
    """The table as texts: null is ``\\N``, and a backslash that begins a text is doubled, so null and the empty text differ. Of binary columns the base64, of nested ones the JSON."""

    def text(name: str, kind: DataType):
        c = F.col(f"`{name}`")
        c = F.base64(c) if isinstance(kind, BinaryType) else F.to_json(c) if isinstance(kind, (ArrayType, MapType, StructType)) else c.cast("string")
        return F.coalesce(F.when(c.startswith("\\"), F.concat(F.lit("\\"), c)).otherwise(c), F.lit("\\N")).alias(name)

    return value.select(*[text(f.name, f.dataType) for f in value.schema.fields])


def _from_csv(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    rows = spark.read.schema(texts).format("csv").options(**OPTIONS["csv"]).load(path)

    def typed(f: StructField):
        c = F.coalesce(F.col(f"`{f.name}`"), F.lit(""))  # the empty text
        c = F.when(c == "\\N", None).when(c.startswith("\\\\"), F.substring(c, 2, 2**31 - 1)).otherwise(c)
        nested = isinstance(f.dataType, (ArrayType, MapType, StructType))
        return (F.unbase64(c) if isinstance(f.dataType, BinaryType) else F.from_json(c, f.dataType) if nested else c.cast(f.dataType)).alias(f.name)

    return rows.select(*map(typed, schema.fields))


class Locked(RuntimeError):
    pass


class Store:
    VERSION = 1

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, f"{path.rstrip('/')}/files")
        if self.files.exists(f"{self.path}/session.json"):
            if (version := json.loads(self.files.read(f"{self.path}/session.json")).get("version")) != self.VERSION:
                raise ValueError(f"the store has format version {version}, not {self.VERSION}")
        else:
            self.files.mkdirs(self.path)
            self.files.write(f"{self.path}/session.json", json.dumps({"version": self.VERSION, "seed": None, "spark": spark.version}))

    # records

    def _get(self, kind: str, name: str) -> dict | None:
        path = f"{self.path}/{kind}/{name}.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else None

    def _put(self, kind: str, name: str, record: dict) -> None:
        self.files.write(f"{self.path}/{kind}/{name}.json", json.dumps(record, default=str))

    def _names(self, kind: str) -> list[str]:
        return [n[:-5] for n in self.files.names(f"{self.path}/{kind}") if n.endswith(".json")]

    def session(self) -> dict:
        return json.loads(self.files.read(f"{self.path}/session.json"))

    def set_seed(self, seed: int) -> None:
        self.files.write(f"{self.path}/session.json", json.dumps(self.session() | {"seed": seed}))

    def meta(self, target: str) -> dict | None:
        return self._get("meta", target)

    def diagnose(self, target: str) -> dict:
        if (found := self.meta(target)) is None:
            raise KeyError(f"nothing is known about {target}")
        return found

    def cached(self) -> list[str]:
        """Targets that have a stored value."""
        return [n for n in self._names("meta") if (m := self.meta(n)) and m.get("hash") and self.has(m["hash"])]

    def cached_planned(self, plan) -> list[str]:
        """Targets of the plan that have a stored value."""
        return [n for n in self.cached() if n in plan.targets]

    def cached_unplanned(self, plan) -> list[str]:
        """Stored targets that the plan no longer has."""
        return [n for n in self.cached() if n not in plan.targets]

    def _records(self, kind: str, schema: str) -> DataFrame:
        """All records of a kind, read by the executors."""
        path = f"{self.path}/{kind}"
        if not self.files.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(path)

    def progress(self, *statuses: str) -> DataFrame:
        rows = self._records("progress", "target string, status string, at double")
        return rows.where(F.col("status").isin(*statuses)) if statuses else rows

    def set_progress(self, target: str, status: str) -> None:
        self._put("progress", target, {"target": target, "status": status, "at": time.time()})

    def metas(self) -> DataFrame:
        return self._records("meta", META)

    def history(self, analyze: bool = False) -> DataFrame:
        """Every build, oldest first, and whether its result is still stored and is the current one.

        With ``analyze`` there is a text column more for each argument with a plain value that a command was given
        or that its code passes on by name; arguments named like other columns get ``_argument`` behind.
        """
        rows = self._records("history", "target string, built double, hash string, command string, elapsed double, seed long, arguments map<string,string>")
        stored = self.spark.createDataFrame([(n,) for n in self.files.names(f"{self.path}/objects")], "hash string").withColumn("_stored", F.lit(True))
        now = self.metas().select("target", F.col("hash").alias("_now"))
        rows = rows.join(stored, "hash", "left").join(now, "target", "left")
        is_now = F.coalesce(F.col("_now") == F.col("hash"), F.lit(False))
        columns = ["target", "built", "hash", "command", "elapsed", "seed", "exists", "current"]
        rows = rows.select(*columns[:6], F.coalesce("_stored", F.lit(False)).alias("exists"), is_now.alias("current"), "arguments")
        names = rows.select(F.explode(F.map_keys("arguments")).alias("k")).distinct().orderBy("k").collect() if analyze else []  # names in the plan's code
        mined = [F.try_element_at("arguments", F.lit(r["k"])).alias(f"{r['k']}_argument" if r["k"] in columns else r["k"]) for r in names]
        return rows.select(*columns, *mined).orderBy("built", "target")

    def cache_log(self) -> DataFrame:
        return self.metas().select("hash", "format", "target")

    def write_cache_log(self, path: str) -> None:
        """The cache log as one CSV text, a line for each target by name, for version control."""
        rows = sorted((str(r["target"]), str(r["hash"]), str(r["format"])) for r in self.cache_log().collect())  # a line for each target of the plan
        self.files.write(path, "hash,format,target\n" + "".join(f"{h},{f},{t}\n" for t, h, f in rows))

    def record(self, meta: dict) -> None:
        """Metadata of a build: first its history, then what makes it current."""
        self._put("history", f"{time.time():.6f}-{uuid.uuid4().hex[:8]}", meta)
        if not meta.get("error") and meta.get("recovery_key"):
            self._put("recover", meta["recovery_key"], meta)
        self._put("meta", meta["target"], meta)

    def recoverable(self, key: str) -> dict | None:
        found = self._get("recover", key)
        return found if found and self.has(found["hash"]) else None

    # values

    def has(self, hash_: str) -> bool:
        return self.files.exists(f"{self.path}/objects/{hash_}")

    def write(self, value: Any, format_: str = "parquet") -> str:
        """Stores a value and returns its fingerprint. A table is hashed from what was written, in one pass."""
        temporary = f"{self.path}/objects/_{uuid.uuid4().hex}"
        if isinstance(value, DataFrame):
            schema = value.schema
            kind = format_ if format_ in ("parquet", "orc", "json", "csv") else "parquet"
            value = _as_csv(value) if kind == "csv" else value
            value.write.format(kind).options(**OPTIONS.get(kind, {})).save(f"{temporary}/table")
            self.files.create(f"{temporary}/schema.json", json.dumps({"format": kind, "schema": schema.jsonValue()}))
            hash_ = table_fingerprint(self._table(temporary))
        elif format_ == "file":
            record = self._watched(value)
            self.files.create(f"{temporary}/files.json", json.dumps(record))
            hash_ = digest("file", json.dumps(record, sort_keys=True))
        else:
            text = base64.b64encode(pickle.dumps(value)).decode()
            self.files.create(f"{temporary}/value.json", json.dumps({"pickle": text}))
            hash_ = digest("value", text)
        if self.has(hash_) or not self.files.move(temporary, f"{self.path}/objects/{hash_}"):
            self.files.delete(temporary)
        return hash_

    def _table(self, at: str) -> DataFrame:
        about = json.loads(self.files.read(f"{at}/schema.json"))
        schema = StructType.fromJson(about["schema"])
        if about["format"] == "csv":
            return _from_csv(self.spark, schema, f"{at}/table")
        return self.spark.read.schema(schema).format(about["format"]).options(**OPTIONS.get(about["format"], {})).load(f"{at}/table")

    def _watched(self, value: Any) -> dict:
        """The paths that a command of format ``file`` returned, with their fingerprints; all must exist."""
        paths = [value] if isinstance(value, str) else list(value or [])
        if any(not isinstance(p, str) for p in paths):
            raise TypeError("a target of format file must return a path or a list of paths")
        found = {p: self.files.fingerprint(p) for p in paths}
        if missing := [p for p, h in found.items() if h is None]:
            raise FileNotFoundError(f"files that were returned do not exist: {', '.join(missing)}")
        return {"paths": paths, "single": isinstance(value, str), "fingerprints": found}

    def files_changed(self, hash_: str) -> bool:
        """Whether a file that the object of format ``file`` names has changed or gone."""
        at = f"{self.path}/objects/{hash_}/files.json"
        return self.files.exists(at) and any(self.files.fingerprint(p) != h for p, h in json.loads(self.files.read(at))["fingerprints"].items())

    def get(self, hash_: str) -> Any:
        at = f"{self.path}/objects/{hash_}"
        if self.files.exists(f"{at}/files.json"):
            record = json.loads(self.files.read(f"{at}/files.json"))
            return record["paths"][0] if record["single"] else record["paths"]
        if self.files.exists(f"{at}/value.json"):
            return pickle.loads(base64.b64decode(json.loads(self.files.read(f"{at}/value.json"))["pickle"]))
        return self._table(at)

    def read(self, target: str, branches: list[int] | None = None) -> Any:
        """A target's value; of a dynamic one all branches or the given ones."""
        value = self.get(self.diagnose(target)["hash"])
        return value.where(value["_branch"].isin(branches)) if branches is not None else value

    def load(self, *targets: str, select: Callable[[str], bool] | None = None) -> list[str]:
        """Registers tables as temporary views: the named ones, and those stored whose name ``select`` accepts."""
        chosen = list(dict.fromkeys([*targets, *(n for n in (self.cached() if select else []) if select(n))]))
        for t in chosen:
            self.read(t).createOrReplaceTempView(t)
        return chosen

    def branches(self, target: str) -> DataFrame:
        """(_branch, subtarget, _branch_key, _occurrence, and the traced columns) of a dynamic target, a row for each branch."""
        meta = self.diagnose(target)
        if not meta.get("manifest"):
            raise ValueError(f"{target} has no branches")
        rows = self.get(meta["manifest"])
        repeated = F.when(F.col("_occurrence") > 1, F.concat(F.lit("_"), F.col("_occurrence").cast("string"))).otherwise("")
        name = F.concat(F.lit(f"{target}_"), F.substring("_branch_key", 1, 8), repeated)
        return rows.withColumn("subtarget", name).select("_branch", "subtarget", *[c for c in rows.columns if c != "_branch"])

    def branch_errors(self, target: str) -> DataFrame:
        """(_branch, _branch_key, _occurrence, error): the branches of a dynamic target that failed in its last build."""
        if not (found := self.diagnose(target).get("branch_errors")):
            return self.spark.createDataFrame([], "_branch long, _branch_key string, _occurrence long, error string")
        return self.get(found).select("_branch", "_branch_key", "_occurrence", "error")

    def values(self, target: str, column: str) -> list:
        """A column of a dynamic target as a list in the order of its branches, such as was branched over."""
        rows = self.read(target)
        return [r[column] for r in rows.select("_branch", column).orderBy("_branch").collect()]

    def subtargets(self, target: str, branches: list[int] | None = None) -> DataFrame:
        """(_branch, subtarget): the names of a dynamic target's branches, or of the given ones."""
        rows = self.branches(target).select("_branch", "subtarget")
        return rows if branches is None else rows.where(F.col("_branch").isin(branches))

    def read_trace(self, column: str, target: str) -> DataFrame:
        """(_branch, column): what a dynamic target's traced column was for each branch."""
        rows = self.branches(target)
        if column not in rows.columns or column.startswith("_"):
            raise KeyError(f"{target} has no trace of {column}")
        return rows.select("_branch", column)

    def memo(self, key: Any, command: Callable[[], Any], format_: str = "parquet") -> Any:
        """The stored result of ``command`` for this key; runs it only the first time."""
        name = digest("memo", repr(key))
        found = self._get("memo", name)
        if not found or not self.has(found["hash"]):
            found = {"hash": self.write(command(), format_)}
            self._put("memo", name, found)
        return self.get(found["hash"])

    def object_path(self, target: str) -> str:
        """The folder that holds a target's value."""
        return f"{self.path}/objects/{self.diagnose(target)['hash']}"

    def tempfile(self, suffix: str = "") -> str:
        """A new path beside the store's objects, so that what is written there can be moved cheaply; ``gc`` removes it."""
        return f"{self.path}/objects/_{uuid.uuid4().hex}{suffix}"

    # housekeeping

    def lock(self) -> None:
        if not self.files.create(f"{self.path}/lock", json.dumps({"at": time.time()})):
            raise Locked(f"another run uses {self.path}; unlock() it if that has ended")

    def unlock(self) -> None:
        self.files.delete(f"{self.path}/lock")

    def which_clean(self, *targets: str) -> list[str]:
        return [n for n in self._names("meta") if not targets or n in targets]

    def clean(self, *targets: str, purge: bool = False, garbage_collection: bool = False, destroy: bool = False) -> None:
        """Forgets targets (all if none is named). Their values stay, and can be recovered, until ``gc``."""
        if destroy:
            self.files.delete(self.path)
            return
        for n in self.which_clean(*targets):
            self.files.delete(f"{self.path}/meta/{n}.json")
            if purge:
                self.files.delete(f"{self.path}/progress/{n}.json")
        if garbage_collection:
            self.gc()

    def gc(self) -> list[str]:
        """Deletes objects that no metadata names; returns their fingerprints. Refused while a run holds the lock, whose objects have no names yet."""
        self.lock()
        try:
            return self._collect_garbage()
        finally:
            self.unlock()

    def _collect_garbage(self) -> list[str]:
        names = ("hash", "manifest", "branch_files", "branch_errors")
        schema = ", ".join(f"{n} string" for n in names)
        named = {h for r in self._records("meta", f"{schema}, kept struct<{schema.replace(' string', ': string')}>").collect() for h in (*r[:-1], *(r["kept"] or ()))}  # a few for each target of the plan
        named |= {r["hash"] for r in self._records("memo", "hash string").collect()}
        gone = [o for o in self.files.names(f"{self.path}/objects") if o not in named]
        for o in gone:
            self.files.delete(f"{self.path}/objects/{o}")
        return gone

    def rescue(self) -> list[str]:
        """Deletes what cannot be read; returns the names of the targets that were lost."""
        lost = []
        for n in self._names("meta"):
            try:
                value = self.get(self.meta(n)["hash"])
                if isinstance(value, DataFrame):
                    table_fingerprint(value)  # reads every row
            except Exception:
                lost.append(n)
                self.files.delete(f"{self.path}/meta/{n}.json")
        return lost

    def import_from(self, other: Store, *targets: str, history: bool = True) -> None:
        """Copies targets with their metadata and their history, but not their progress."""
        chosen = list(targets or other.cached())
        for n in chosen:
            meta = other.diagnose(n)
            for field, format_ in (("hash", meta.get("format") or "parquet"), ("manifest", "parquet"), ("branch_files", "parquet")):
                if (hash_ := meta.get(field)) and not self.has(hash_):
                    meta[field] = self.write(other.get(hash_), format_)  # a value may be pickled in other bytes
            self._put("meta", n, meta)
            if meta.get("recovery_key"):
                self._put("recover", meta["recovery_key"], meta)
        for n in other._names("history") if history else []:
            if (entry := other._get("history", n)) and entry["target"] in chosen:
                self._put("history", n, entry)

    def export_to(self, path: str, *targets: str) -> Store:
        """A store elsewhere with these targets, or all."""
        other = Store(self.spark, path)
        other.import_from(self, *targets)
        return other


def find_store(files: Files, start: str, name: str = ".rivulet") -> str | None:
    """The nearest store in a folder or the folders above it."""
    at = start.rstrip("/")
    while at:
        if files.exists(f"{at}/{name}/session.json"):
            return f"{at}/{name}"
        at = at.rpartition("/")[0]
    return None
