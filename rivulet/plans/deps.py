"""What commands depend on, and fingerprints of their code."""

from __future__ import annotations

import ast
import functools
import hashlib
import inspect
import re
import sys
import textwrap
from collections.abc import Callable
from typing import Any

from rivulet.plans.plan import Plan, Ref, Slice, Target
from rivulet.plans.relations import relations


def digest(*parts: Any) -> str:
    return hashlib.md5("\x1f".join(map(str, parts)).encode()).hexdigest()


def ignore(x):
    """Marks code whose text and dependencies are not tracked."""
    return x


def no_deps(x):
    """Marks code whose text is tracked but not what it depends on."""
    return x


def file_in(*paths: str):
    """Declares input files (literal paths) and returns them."""
    return paths[0] if len(paths) == 1 else paths


def file_out(*paths: str):
    """Declares output files (literal paths) and returns them."""
    return paths[0] if len(paths) == 1 else paths


def report_in(*paths: str):
    """Declares reports (notebooks, Markdown or Python files) whose code reads targets, and returns them.

    The files are watched like input files, and every target that their code
    names in ``read("...")`` or ``load("...")`` is a dependency.
    """
    return paths[0] if len(paths) == 1 else paths


def report_code(path: str) -> str:
    """The Python code of a report, a source file of the project like the plan itself."""
    import json
    from pathlib import Path

    text = Path(path).read_text()
    if path.endswith(".ipynb"):
        return "\n".join("".join(c["source"]) for c in json.loads(text)["cells"] if c["cell_type"] == "code")
    if path.endswith(".py"):
        return text
    return "\n".join(re.findall(r"^```\s*\{?python[^\n]*\n(.*?)^```", text, re.M | re.S))


def report_targets(path: str) -> list[str]:
    """Names that a report's code passes to ``read`` or ``load``; none if the file is missing or no code."""
    try:
        tree = ast.parse(report_code(path))
    except (OSError, SyntaxError, ValueError, KeyError):
        return []
    return sorted({a.value for node in ast.walk(tree) if isinstance(node, ast.Call) and _called(node) in ("read", "load") for a in node.args if isinstance(a, ast.Constant) and isinstance(a.value, str)})


class _Unmarked(ast.NodeTransformer):
    def visit_Call(self, node: ast.Call):
        if _called(node) == "ignore":
            return ast.Constant("ignored")
        return self.generic_visit(node)


def _called(node: ast.Call) -> str | None:
    return node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None


def _tree(f: Callable) -> ast.AST | None:
    try:
        tree = ast.parse(textwrap.dedent(inspect.getsource(f)))
    except (OSError, TypeError, SyntaxError, IndentationError):
        return None
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant):
            node.body = node.body[1:] or [ast.Pass()]
    return tree


def code_text(f: Callable) -> str:
    """A function's code without comments, layout, documentation and ignored parts."""
    tree = None if f.__name__ == "<lambda>" else _tree(f)
    if tree is None:
        code = f.__code__
        return repr((code.co_code, code.co_names, [c for c in code.co_consts if not hasattr(c, "co_code")], [c.co_code for c in code.co_consts if hasattr(c, "co_code")]))
    return ast.dump(ast.fix_missing_locations(_Unmarked().visit(tree)))


def sql_text(sql: str) -> str:
    """SQL without comments, white space made even."""
    sql = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    return " ".join(sql.split())


def sql_relations(sql: str) -> set[str]:
    """Relations that a query reads, those it defines itself left out."""
    return {name for name, _, _ in relations(sql)}


def globals_of(f: Callable) -> dict[str, Any]:
    """Names outside a function that its code uses, with their values; what is behind ``no_deps`` or ``ignore`` is left out."""
    hidden: set[str] = set()
    if (tree := _tree(f)) is not None:
        shown: set[str] = set()
        for node in ast.walk(tree):
            if isinstance(node, ast.Call) and _called(node) in ("ignore", "no_deps"):
                hidden |= {n.id for a in node.args for n in ast.walk(a) if isinstance(n, ast.Name)}
        class Seen(ast.NodeVisitor):
            def visit_Call(self, node):
                if _called(node) not in ("ignore", "no_deps"):
                    self.generic_visit(node)

            def visit_Name(self, node):
                shown.add(node.id)

        Seen().visit(tree)
        hidden -= shown
    names: set[str] = set()

    def walk(code):
        names.update(code.co_names)
        for c in code.co_consts:
            if hasattr(c, "co_code"):
                walk(c)

    walk(f.__code__)
    found = {n: f.__globals__[n] for n in names if n in f.__globals__}
    cells = zip(f.__code__.co_freevars, f.__closure__ or (), strict=True)
    found |= {n: c.cell_contents for n, c in cells}
    return {n: v for n, v in found.items() if n not in hidden}


def function_fingerprint(f: Callable, seen: set[int] | None = None) -> str:
    """Of a function's code and, recursively, of the functions and plain values it uses.

    Classes count with their methods and what they inherit, dispatching functions with
    all they dispatch to, partials with their arguments. What is of installed packages counts by name only.
    """
    seen = seen or set()
    if id(f) in seen:
        return "again"
    seen.add(id(f))
    parts = [code_text(f), repr(f.__defaults__)]
    for name, value in sorted(globals_of(f).items()):
        parts.append(f"{name}={_value_fingerprint(value, seen)}")
        if inspect.ismodule(value) and not _installed(getattr(value, "__file__", None)):
            for attribute in sorted(_attributes(f)):
                if inspect.isfunction(inner := getattr(value, attribute, None)):
                    parts.append(f"{name}.{attribute}={_value_fingerprint(inner, seen)}")
    return digest(*parts)


def _installed(path: str | None) -> bool:
    return any(x in (path or "site-packages") for x in ("site-packages", "lib/python", "/pyspark/"))


def _attributes(f: Callable) -> set[str]:
    """Attributes that a function's code, and code within it, asks for."""
    found, todo = set(), [f.__code__]
    while todo:
        code = todo.pop()
        found |= set(code.co_names)
        todo += [c for c in code.co_consts if hasattr(c, "co_code")]
    return found


def class_fingerprint(cls: type, seen: set[int]) -> str:
    """Of the methods, properties and plain attributes of a class and of those it inherits from, installed ones by name."""
    if id(cls) in seen:
        return "again"
    seen.add(id(cls))
    parts = []
    for of in cls.__mro__:
        parts.append(of.__qualname__)
        if _installed(getattr(sys.modules.get(of.__module__), "__file__", None)):
            continue
        for name, value in sorted(vars(of).items()):
            if name in ("__module__", "__doc__", "__dict__", "__weakref__", "__firstlineno__", "__static_attributes__", "__annotations__", "__annotate_func__", "__annotations_cache__"):
                continue
            inner = [value.fget, value.fset, value.fdel] if isinstance(value, property) else [getattr(value, "__func__", value)]
            parts += [f"{name}={_value_fingerprint(v, seen)}" for v in inner if v is not None]
    return digest(*parts)


def tracked_code(value: Any) -> bool:
    """Whether a value is code whose text counts: a function, or a class, partial, dispatcher or instance of the project's own."""
    if inspect.isfunction(value) or isinstance(value, functools.partial) or hasattr(value, "__wrapped__"):
        return True
    cls = value if inspect.isclass(value) else type(value)
    return not inspect.ismodule(value) and not _installed(getattr(sys.modules.get(cls.__module__), "__file__", None))


def _value_fingerprint(value: Any, seen: set[int]) -> str:
    if isinstance(value, functools.partial):
        return digest("partial", _value_fingerprint(value.func, seen), repr(value.args), repr(sorted(value.keywords.items())))
    if hasattr(value, "registry") and hasattr(value, "dispatch"):  # one function for each type of argument
        return digest("dispatch", *sorted(f"{getattr(k, '__qualname__', k)}={_value_fingerprint(v, seen)}" for k, v in value.registry.items()))
    if not inspect.isfunction(value) and hasattr(value, "__wrapped__"):
        return digest("wrapped", _value_fingerprint(value.__wrapped__, seen))
    if inspect.ismethod(value):
        return digest("method", _value_fingerprint(value.__func__, seen), class_fingerprint(type(value.__self__), seen))
    if inspect.isfunction(value):
        return value.__qualname__ if _installed(inspect.getsourcefile(value) or "-") else function_fingerprint(value, seen)
    if isinstance(value, (str, int, float, bool, bytes, type(None), tuple, list, dict, set, frozenset)):
        return digest(repr(value))
    if tracked_code(value):  # an instance counts by its class, not by its state
        return class_fingerprint(value if inspect.isclass(value) else type(value), seen)
    return getattr(value, "__name__", type(value).__name__)


def literal_calls(f: Callable, name: str) -> list[str]:
    """Literal paths that a function passes to ``file_in`` or ``file_out``."""
    tree = _tree(f)
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and _called(n) == name] if tree else []
    return [a.value for c in calls for a in c.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]


def _helpers(f: Callable, seen: dict[int, Callable]) -> list[Callable]:
    """Own functions that a function calls, directly or through others."""
    for v in globals_of(f).values():
        if inspect.isfunction(v) and id(v) not in seen and not _installed(inspect.getsourcefile(v) or "-"):
            seen[id(v)] = v
            _helpers(v, seen)
    return list(seen.values())


def check_helpers(f: Callable) -> None:
    """Output files and reports must be named by commands, not by the functions that these call: only a command's are tracked."""
    for helper in _helpers(f, {}):
        for kind in ("file_out", "report_in"):
            if paths := literal_calls(helper, kind):
                raise ValueError(f"{kind} in {helper.__qualname__}, which is not a command: {', '.join(sorted(paths))}")


def literal_arguments(t: Target) -> dict[str, str]:
    """Named arguments with plain values that a command is bound to or passes on in its code; of several with one name the first."""
    found = {k: str(v) for k, v in t.bindings.items() if isinstance(v, (str, int, float, bool))}
    tree = _tree(t.command) if callable(t.command) else None
    for node in ast.walk(tree) if tree else ():
        for k in node.keywords if isinstance(node, ast.Call) and _called(node) not in ("ignore", "no_deps") else ():
            try:
                value = ast.literal_eval(k.value)
            except (ValueError, TypeError, SyntaxError):
                continue
            if k.arg and isinstance(value, (str, int, float, bool)):
                found.setdefault(k.arg, str(value))
    return found


def refs(value: Any) -> set[str]:
    if isinstance(value, Ref):
        return {value.target}
    if isinstance(value, Slice):
        return {value.of.target}
    return set().union(*map(refs, value)) if isinstance(value, list) else set()


def dependencies(t: Target, known: set[str]) -> dict[str, set[str]]:
    """A target's dependencies by kind: targets, functions, file_in, file_out."""
    bound = set().union(*(refs(v) for v in t.bindings.values())) if t.bindings else set()
    if callable(t.command):
        check_helpers(t.command)
        parameters = {p for p in t.parameters() if p not in t.bindings and p in known}
        used = {r for p, v in t.bindings.items() if p in t.parameters() for r in refs(v)}
        functions = {n for n, v in globals_of(t.command).items() if tracked_code(v)}
        files = {k: set(literal_calls(t.command, k)) for k in ("file_in", "file_out")}
        named = {x for kind in ("read", "load") for x in literal_calls(t.command, kind)} & known
        reports = literal_calls(t.command, "report_in")
        files["file_in"] |= set(reports)
        named |= {n for path in reports for n in report_targets(path)} & known
        targets = parameters | used | named
    else:
        targets, functions, files = sql_relations(t.command) & known, set(), {"file_in": set(), "file_out": set()}
        targets |= {r for r in bound if r in known and re.search(rf"\b{re.escape(r)}\b", t.command)}
    if t.dynamic:
        targets |= t.dynamic.targets() & known
    return {"targets": targets - {t.name}, "functions": functions, **files}


def graph(plan: Plan) -> list[tuple[str, str]]:
    """Edges between targets; a target that reads a file depends on the one that writes it."""
    known = set(plan.targets)
    deps = {n: dependencies(t, known) for n, t in plan.targets.items()}
    makers = {f: n for n, d in deps.items() for f in d["file_out"]}
    edges = {(a, n) for n, d in deps.items() for a in d["targets"]}
    edges |= {(makers[f], n) for n, d in deps.items() for f in d["file_in"] if f in makers and makers[f] != n}
    return sorted(edges)


def build_order(plan: Plan, edges: list[tuple[str, str]] | None = None) -> list[str]:
    """Targets in an order in which each comes after what it depends on; an error names a cycle."""
    edges = graph(plan) if edges is None else edges
    waiting = {n: {a for a, b in edges if b == n} for n in plan.targets}
    out: list[str] = []
    while waiting:
        ready = [n for n, d in waiting.items() if not d & set(waiting)]
        if not ready:
            raise ValueError(f"circular dependencies: {', '.join(sorted(waiting))}")
        out += ready
        for n in ready:
            del waiting[n]
    return out


def reach(edges: list[tuple[str, str]], start: set[str], upstream: bool = False) -> set[str]:
    """The starting names and all up- or downstream of them."""
    out, new = set(start), set(start)
    while new:
        new = {(a if upstream else b) for a, b in edges if (b if upstream else a) in new} - out
        out |= new
    return out
