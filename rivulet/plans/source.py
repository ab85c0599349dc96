"""Plans as source code and notebooks, and scripts as functions."""

from __future__ import annotations

import ast
import builtins
import json
import linecache
from collections.abc import Callable
from pathlib import Path

from rivulet.functions.names import sanitize
from rivulet.plans.deps import build_order
from rivulet.plans.plan import Plan, Target, Trigger, command_text


def _argument(value) -> str:
    return value.__name__ if callable(value) else repr(value)


def _target_source(t: Target) -> str:
    command = getattr(t.command, "__name__", "command") if callable(t.command) else repr(t.command)
    options = []
    if t.dynamic:
        names = [repr(n) for n in t.dynamic.names]
        names += [f"{k}={v!r}" for k, v in (("by", t.dynamic.by), ("order", t.dynamic.order), ("trace", t.dynamic.trace)) if v]
        options.append(f"dynamic=dynamic_{t.dynamic.kind}({', '.join(names)})")
    plain = Target("")
    for name in ("format", "seed", "retries", "elapsed", "max_expand", "priority", "memory", "parallel", "custom"):
        if getattr(t, name) != getattr(plain, name):
            options.append(f"{name}={getattr(t, name)!r}")
    changed = {k: v for k, v in vars(t.trigger).items() if v != getattr(Trigger(), k)}
    if changed:
        options.append(f"trigger=Trigger({', '.join(f'{k}={_argument(v)}' for k, v in changed.items())})")
    return f"Target({', '.join([command, *options])})" if options else command


def plan_source(plan: Plan) -> str:
    """Python code that makes the plan again; functions stand there by their names, and targets that a transform wrote one by one."""
    used = ["Plan", *(x for x in ("Target", "Trigger") if any(x in _target_source(t) for t in plan.targets.values()))]
    used += sorted({f"dynamic_{t.dynamic.kind}" for t in plan.targets.values() if t.dynamic})
    rows = "".join(f"        {n!r}: {_target_source(t)},\n" for n, t in plan.targets.items())
    return f"from rivulet.plans.plan import {', '.join(used)}\n\nplan = Plan(\n    {{\n{rows}    }}\n)\n"


def plan_to_notebook(plan: Plan, path: str | None = None) -> str:
    """A notebook with a cell for each target, in the order in which they can be built; written to ``path`` if one is given."""
    cells = [{"cell_type": "code", "execution_count": None, "metadata": {}, "outputs": [], "source": [f"{n} = {command_text(plan[n])}"]} for n in build_order(plan)]
    text = json.dumps({"cells": cells, "metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 5}, indent=1)
    if path:
        Path(path).write_text(text)
    return text


def notebook_to_code(path: str) -> str:
    """The code cells of a notebook, one after the other."""
    return "\n".join("".join(c["source"]) for c in json.loads(Path(path).read_text())["cells"] if c["cell_type"] == "code")


def code_to_function(path: str, result: str | None = None) -> Callable:
    """A script as a function that can be a target's command.

    Its parameters are the names that the script uses but does not define, so
    they can be other targets (or ``ctx``); it returns the name ``result``, or the value
    of the script's last expression. Its code is tracked like any function's.
    """
    text = Path(path).read_text() if not path.endswith(".ipynb") else notebook_to_code(path)
    tree = ast.parse(text)
    defined = {a.asname or a.name.partition(".")[0] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    defined |= {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.ClassDef))} | {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)}
    names = [n for n in ast.walk(tree) if isinstance(n, ast.Name)]
    defined |= {n.id for n in names if isinstance(n.ctx, ast.Store)}
    parameters = list(dict.fromkeys(n.id for n in sorted(names, key=lambda n: (n.lineno, n.col_offset)) if n.id not in defined and not hasattr(builtins, n.id)))
    if result:
        tree.body.append(ast.Return(ast.Name(result, ast.Load())))
    elif tree.body and isinstance(tree.body[-1], ast.Expr):
        tree.body[-1] = ast.Return(tree.body[-1].value)
    name = sanitize(Path(path).stem).replace(".", "_")
    body = ast.unparse(ast.fix_missing_locations(ast.Module(tree.body, [])))
    source = f"def {name}({', '.join(parameters)}):\n" + "".join(f"    {line}\n" for line in (body or "pass").split("\n"))
    file = f"<{path}>"
    linecache.cache[file] = (len(source), None, source.splitlines(keepends=True), file)
    space: dict = {}
    exec(compile(source, file, "exec"), space)
    return space[name]
