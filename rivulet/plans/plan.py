"""Plans and the static grammar that writes families of targets.

A command is a Python function, whose parameters name what it depends on, or SQL
text, whose relations do. ``map_``, ``cross_``, ``split_`` and ``combine_`` repeat a
target for values or for targets before it; what a repeated target stands for is
bound to the parameter (or the word in the SQL text) of that name.
"""

from __future__ import annotations

import ast
import hashlib
import inspect
import itertools
import linecache
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rivulet.functions.names import make_unique, sanitize
from rivulet.operators.branching import spaced_ordinals
from rivulet.plans.relations import outside_literals

RESERVED = {"ctx", "self", "None", "True", "False"}


@dataclass(frozen=True)
class Ref:
    """Stands for the value of a target."""

    target: str


@dataclass(frozen=True)
class Transform:
    kind: str
    names: tuple[str, ...] = ()
    values: tuple[tuple[str, tuple], ...] = ()
    by: tuple[str, ...] = ()
    slices: int = 0
    id: Any = True
    target_names: tuple[str, ...] | None = None
    tag_in: tuple[str, ...] = ()
    tag_out: tuple[str, ...] = ()


def _tuple(x) -> tuple[str, ...]:
    return () if x is None else (x,) if isinstance(x, str) else tuple(x)


def _transform(kind: str, names, values: dict, by=None, slices: int = 0, data: Iterable[dict] | None = None, id=True, target_names=None, tag_in=None, tag_out=None) -> Transform:
    if data is not None:
        rows = list(data)
        values = {**{k: [r[k] for r in rows] for k in (rows[0] if rows else {})}, **values}
    if not names and not values:
        raise ValueError(f"{kind} needs something to branch over")
    cells = tuple((k, tuple(v)) for k, v in values.items())
    return Transform(kind, tuple(names), cells, _tuple(by), slices, id, None if target_names is None else tuple(target_names), _tuple(tag_in), _tuple(tag_out))


def map_(*names: str, data=None, id=True, target_names=None, tag_in=None, tag_out=None, **values) -> Transform:
    """One target for each row of the values, zipped, and of the named targets or grouping variables."""
    return _transform("map", names, values, data=data, id=id, target_names=target_names, tag_in=tag_in, tag_out=tag_out)


def cross_(*names: str, data=None, id=True, target_names=None, tag_in=None, tag_out=None, **values) -> Transform:
    """One target for each combination, the first variable varying fastest."""
    return _transform("cross", names, values, data=data, id=id, target_names=target_names, tag_in=tag_in, tag_out=tag_out)


def split_(name: str, slices: int, **options) -> Transform:
    """One target for each contiguous slice of the named target's rows."""
    return _transform("split", (name,), {}, slices=slices, **options)


def combine_(*names: str, by=None, **options) -> Transform:
    """One target for all targets of the named families, or for each group of them; it gets lists."""
    return _transform("combine", names, {}, by=by, **options)


@dataclass(frozen=True)
class Trigger:
    """Which changes make a target out of date."""

    command: bool = True
    depend: bool = True
    file: bool = True
    seed: bool = True
    format: bool = True
    condition: Callable[[], bool] | bool = False
    change: Callable[[], Any] | None = None
    mode: str = "whitelist"

    def __post_init__(self):
        if self.mode not in ("whitelist", "blacklist", "condition"):
            raise ValueError(f"unknown trigger mode: {self.mode}")


@dataclass(frozen=True)
class Dynamic:
    """Branches over the rows of targets already built."""

    kind: str
    names: tuple[str, ...]
    by: str | None = None
    order: tuple[str, ...] = ()
    trace: tuple[str, ...] = ()
    each: str | None = None
    explode: str | None = None

    def targets(self) -> set[str]:
        """What is branched over, and the target that ``by`` may be read from."""
        return {*self.names, *([self.by.partition(".")[0]] if self.by and "." in self.by else [])}


def dynamic_map(*names: str, order: str | Iterable[str] = (), trace: str | Iterable[str] = (), each: str | None = None, explode: str | None = None) -> Dynamic:
    """One branch for each element of the named targets, zipped: a row of a table, a branch of a dynamic target, an item of a list or dictionary.

    ``trace`` names columns to remember for each branch. A command gets the rows of all branches to
    build as one table; with ``each``, the result's columns as DDL, it is called for each branch by itself, in the executors,
    with the branch's rows as a pandas DataFrame (and ``seed``, if it has such a parameter). ``explode`` makes one branch of
    each item of an array or map column.
    """
    return Dynamic("map", names, order=_tuple(order), trace=_tuple(trace), each=each, explode=explode)


def dynamic_cross(*names: str, order: str | Iterable[str] = (), trace: str | Iterable[str] = (), each: str | None = None) -> Dynamic:
    """One branch for each combination of elements of the named targets, the first slowest."""
    return Dynamic("cross", names, order=_tuple(order), trace=_tuple(trace), each=each)


def dynamic_group(*names: str, by: str | None = None, order: str | Iterable[str] = (), trace: str | Iterable[str] = (), each: str | None = None) -> Dynamic:
    """One branch for each key, in the order of the keys' first rows; of several targets the rows are zipped.

    ``by`` is a column of theirs, or ``target.column`` of another target with as
    many rows. Traced columns should be constant within a group; the least value counts.
    """
    return Dynamic("group", names, by=by, order=_tuple(order), trace=_tuple(trace), each=each)


def dynamic_combine(*_args, **_options):
    raise ValueError("dynamic combine is not defined; use dynamic_group")


@dataclass(frozen=True)
class Target:
    command: Callable | str
    transform: Transform | None = None
    dynamic: Dynamic | None = None
    format: str = "parquet"
    trigger: Trigger = field(default_factory=Trigger)
    seed: int | None = None
    retries: int = 0
    elapsed: float | None = None
    max_expand: int | None = None
    priority: float = float("inf")
    memory: str | None = None
    parallel: bool = True
    #: The scheduler pool of the target's jobs.
    pool: str | None = None
    #: What executors and tasks of commands run for each branch ask for; see ``rivulet.plans.resources``.
    resources: dict[str, Any] = field(default_factory=dict)
    #: Parts that a dynamic target is built and committed in, one after the other.
    ranges: int = 1
    custom: dict[str, Any] = field(default_factory=dict)
    name: str = ""
    bindings: dict[str, Any] = field(default_factory=dict)
    trace: dict[str, str] = field(default_factory=dict)

    def parameters(self) -> list[str]:
        return list(inspect.signature(self.command).parameters) if callable(self.command) else []


class Plan:
    """Targets by name. Their order does not matter."""

    def __init__(self, targets: dict[str, Target | Callable | str] | None = None, max_expand: int | None = None, transform: bool = True, **more):
        rows = []
        for name, t in {**(targets or {}), **more}.items():
            t = t if isinstance(t, Target) else Target(t)
            rows.append(replace(t, name=sanitize(name)))
        _check_names([r.name for r in rows])
        self.max_expand = max_expand
        self.targets: dict[str, Target] = {r.name: r for r in rows}
        if transform:
            self.targets = _expand(rows, max_expand)

    def transform(self, max_expand: int | None = None) -> Plan:
        """The plan with its transforms carried out, if that was put off."""
        out = Plan()
        out.targets = _expand(list(self.targets.values()), max_expand or self.max_expand)
        return out

    def __getitem__(self, name: str) -> Target:
        return self.targets[name]

    def __len__(self) -> int:
        return len(self.targets)

    def __repr__(self) -> str:
        return "Plan(" + ", ".join(self.targets) + ")"

    @staticmethod
    def bind(*plans: Plan) -> Plan:
        names = [n for p in plans for n in p.targets]
        _check_names(names)
        out = Plan()
        out.targets = {n: t for p in plans for n, t in p.targets.items()}
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = "target string, command string, kind string, dynamic string, format string, seed int, retries int, elapsed double, max_expand int, trace map<string,string>, custom map<string,string>"
        rows = [
            (t.name, command_text(t), "function" if callable(t.command) else "sql", t.dynamic.kind if t.dynamic else None, t.format, t.seed, t.retries, t.elapsed, t.max_expand, t.trace, {k: str(v) for k, v in t.custom.items()})
            for t in self.targets.values()
        ]
        return spark.createDataFrame(rows, schema)


def command_text(t: Target) -> str:
    if not callable(t.command):
        return t.command
    name = getattr(t.command, "__name__", "command")
    args = (f"{p}={_shown(t.bindings[p])}" if p in t.bindings else p for p in t.parameters())
    return f"{name}({', '.join(args)})"


def _shown(v: Any) -> str:
    return v.target if isinstance(v, Ref) else "[" + ", ".join(map(_shown, v)) + "]" if isinstance(v, list) else repr(v)


def _check_names(names: list[str]) -> None:
    if bad := sorted({n for n in names if not n or n in RESERVED}):
        raise ValueError(f"not allowed as names of targets: {', '.join(map(repr, bad))}")
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"targets must have different names: {', '.join(twice)}")


def _expand(rows: list[Target], max_expand: int | None) -> dict[str, Target]:
    waiting = {r.name: r for r in rows if r.transform}
    groups = {v for r in waiting.values() for v, _ in r.transform.values} | {x for r in waiting.values() for x in (*r.transform.tag_in, *r.transform.tag_out)}
    if clash := groups & {r.name for r in rows}:
        raise ValueError(f"grouping variables with names of targets: {', '.join(sorted(clash))}")
    done: list[Target] = [r for r in rows if not r.transform]
    while waiting:
        ready = [r for r in waiting.values() if not any(n in waiting or _made_by(n, waiting) - {r.name} for n in (*r.transform.names, *r.transform.by))]
        if not ready:
            raise ValueError(f"transforms depend on each other: {', '.join(waiting)}")
        for r in ready:
            done += _expand_one(r, done, r.max_expand if r.max_expand and not r.dynamic else max_expand)
            del waiting[r.name]
    names = make_unique([t.name for t in done])
    return {n: replace(t, name=n) for n, t in zip(names, done, strict=True)}


def _made_by(variable: str, waiting: dict[str, Target]) -> set[str]:
    return {n for n, r in waiting.items() if variable in {v for v, _ in r.transform.values} | {*r.transform.tag_in, *r.transform.tag_out}}


def _old_rows(done: list[Target], names: list[str]) -> list[dict[str, str]]:
    """What ``map_`` zips of variables that earlier targets have.

    Variables that occur together in a trace, directly or through others, are a
    block, and only traces with all of a block count. Blocks have nothing to do
    with each other; they are zipped by position and cut to the shortest one.
    Equal rows count once.
    """
    traces = [r for t in done if (r := {n: t.trace[n] for n in names if n in t.trace})]
    block = {n: n for r in traces for n in names if n in r}
    for r in traces:
        joined, into = {block[n] for n in r}, block[next(iter(r))]
        block = {n: into if b in joined else b for n, b in block.items()}
    columns: dict[str, list[str]] = {}
    for b in dict.fromkeys(block.values()):
        members = [n for n in names if block.get(n) == b]
        whole = [r for r in traces if all(n in r for n in members)]
        columns |= {n: [r[n] for r in whole] for n in members if whole}
    rows = [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=False)]
    return [r for i, r in enumerate(rows) if r not in rows[:i]]


def _with_traces(row: dict[str, str], done: list[Target]) -> dict[str, str]:
    """The row with what goes with it in traces; variables that only some of the traces with its variables have do not."""
    having = [t.trace for t in done if row and all(n in t.trace for n in row)]
    same = next((t for t in having if all(t[n] == v for n, v in row.items())), {})
    return {**{n: v for n, v in same.items() if all(n in t for t in having)}, **row}


def _value(name: str, shown: str, done: list[Target]) -> Any:
    return Ref(shown) if any(t.name == shown for t in done) else shown


def _expand_one(r: Target, done: list[Target], max_expand: int | None) -> list[Target]:
    tr, literal = r.transform, {t.name for t in done if not t.trace}
    cells: list[tuple[dict[str, Any], dict[str, str]]] = []  # bindings, trace
    if tr.kind == "split":
        name = tr.names[0]
        for i in range(1, tr.slices + 1):
            cells.append(({name: Slice(Ref(name), tr.slices, i)}, {f"{name}_index": str(i)}))
    elif tr.kind == "combine":
        found: dict[tuple, dict[str, list[str]]] = {}
        traces: dict[tuple, list[dict[str, str]]] = {}
        for name in tr.names:
            for t in done:
                if name in t.trace and t.trace[name] == t.name and all(k in t.trace for k in tr.by):
                    traces.setdefault(tuple(t.trace[k] for k in tr.by), []).append(t.trace)
                    lists = found.setdefault(tuple(t.trace[k] for k in tr.by), {n: [] for n in tr.names})[name]
                    if t.name not in lists:
                        lists.append(t.name)
        for key, lists in found.items():
            if all(lists.values()):
                first, *others = traces[key]
                # variables that all have alike go along
                along = {n: v for n, v in first.items() if n not in tr.names and all(t.get(n) == v for t in others)}
                cells.append(({n: [Ref(x) for x in v] for n, v in lists.items()}, {**along, **dict(zip(tr.by, key, strict=True))}))
    else:
        old_names = [n for n in tr.names if n not in literal]
        whole = {n: Ref(n) for n in tr.names if n in literal}
        if tr.kind == "map":
            old = [_with_traces(r, done) for r in _old_rows(done, old_names)] if old_names else None
            sizes = [len(v) for _, v in tr.values] + ([len(old)] if old is not None else [])
            n = max(sizes, default=1)
            if any(s == 0 or n % s for s in sizes):
                raise ValueError(f"{r.name}: cannot map over {', '.join(map(str, sizes))} values")
            for i in range(n):
                own = old[i % len(old)] if old is not None else {}
                new = {k: v[i % len(v)] for k, v in tr.values}
                cells.append(({**{k: _value(k, v, done) for k, v in own.items()}, **new, **whole}, {**own, **{k: str(v) for k, v in new.items()}}))
        else:
            columns = [[(k, x) for x in v] for k, v in tr.values]
            for name in old_names:
                seen = list(dict.fromkeys(t.trace[name] for t in done if name in t.trace))
                columns.append([(name, _value(name, s, done)) for s in seen])
            for combo in itertools.product(*reversed(columns)):
                new = dict(reversed(combo))
                trace = {k: v.target if isinstance(v, Ref) else str(v) for k, v in new.items()}
                along = {k: v for n in old_names for k, v in _with_traces({n: trace[n]}, done).items() if k not in trace}
                cells.append(({**{k: _value(k, v, done) for k, v in along.items()}, **new, **whole}, {**along, **trace}))
    if max_expand is not None and tr.kind != "combine":
        cells = [cells[i - 1] for i in spaced_ordinals(len(cells), max_expand)]
    if tr.target_names is not None and len(tr.target_names) != len(cells):
        raise ValueError(f"{r.name}: {len(cells)} targets need as many names")
    out = []
    for i, (bindings, trace) in enumerate(cells):
        asked = {*tr.names, *(k for k, _ in tr.values), *tr.by, *(f"{n}_index" for n in tr.names if tr.kind == "split")}
        wanted = asked if tr.id is True else set() if tr.id is False else set(_tuple(tr.id))
        suffix = [v for k, v in trace.items() if k in wanted] if tr.id is not False else [str(i + 1)]
        name = tr.target_names[i] if tr.target_names else sanitize("_".join([r.name, *suffix]))
        out.append((name, bindings, trace))
    names = make_unique([n for n, _, _ in out])
    made = []
    for name, (_, bindings, trace) in zip(names, out, strict=True):
        tags = {**{g: r.name for g in tr.tag_in}, **{g: name for g in tr.tag_out}}
        command = r.command if callable(r.command) else _substituted(r.command, {**bindings, "_name": name})
        made.append(replace(r, name=name, command=command, bindings=bindings, trace={**trace, r.name: name, **tags}, transform=None))
    return made


@dataclass(frozen=True)
class Slice:
    """The index-th of so many contiguous slices of a target's rows."""

    of: Ref
    slices: int
    index: int


def _substituted(sql: str, bindings: dict[str, Any]) -> str:
    """The SQL text with each bound word replaced; of several targets the union stands for the word."""
    for k, v in bindings.items():
        if isinstance(v, Ref):
            text = v.target
        elif isinstance(v, list):
            text = "(" + " UNION ALL ".join(f"SELECT * FROM {x.target}" for x in v) + ")"
        elif isinstance(v, Slice):
            continue
        else:
            text = str(v)
        sql = outside_literals(sql, k, text)
    return sql


def plan_to_code(plan: Plan, order: list[str] | None = None) -> str:
    """One assignment for each target, in the order in which they can be built; triggers are not shown."""
    return "".join(f"{n} = {command_text(plan[n])}\n" for n in order or plan.targets)


def code_to_plan(text: str, names: dict[str, Any] | None = None) -> Plan:
    """A script as a plan: assignments, or CREATE VIEW statements.

    A string that is assigned is SQL. Any other expression is a command that depends on the
    targets it names; ``names`` holds the functions and other globals that the script uses, besides those it defines or imports itself.
    """
    views = re.findall(r"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+(\w+)\s+as\s+(.*?)(?:;|\Z)", text, re.I | re.S)
    if views:
        return Plan({n: s.strip() for n, s in views})
    script = ast.parse(text)
    found: dict[str, ast.expr] = {}
    space = dict(names or {})
    for node in script.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            exec(compile(ast.Module([node], []), "<script>", "exec"), space)
        elif isinstance(node, ast.FunctionDef):
            space[node.name] = _defined(ast.unparse(node), node.name, space)
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            if node.targets[0].id in found:
                raise ValueError(f"assigned twice: {node.targets[0].id}")
            found[node.targets[0].id] = node.value
        elif not (isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant)):  # a docstring
            raise ValueError(f"line {node.lineno} is neither an assignment nor a function")
    return Plan({n: _assigned(n, e, set(found), space) for n, e in found.items()})


def _assigned(name: str, value: ast.expr, targets: set[str], space: dict[str, Any]) -> Callable | str:
    """The command of an assignment: SQL text, or a function of the targets that the expression names."""
    if isinstance(value, ast.Constant) and isinstance(value.value, str):
        return value.value
    used = dict.fromkeys(n.id for n in ast.walk(value) if isinstance(n, ast.Name) and n.id in targets | {"ctx"})
    return _defined(f"def {name}({', '.join(used)}):\n    return {ast.unparse(value)}\n", name, space)


def _defined(source: str, name: str, space: dict[str, Any]) -> Callable:
    """The function of this source, which can be read again where code is compared."""
    file = f"<script {hashlib.md5(source.encode()).hexdigest()}>"
    linecache.cache[file] = (len(source), None, source.splitlines(keepends=True), file)
    before = space.get(name)
    exec(compile(source, file, "exec"), space)
    made = space.pop(name)
    if before is not None:
        space[name] = before
    return made
