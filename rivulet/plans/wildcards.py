"""Older ways to write families of targets: wildcards, and trees of reductions.

A plan is here a list of rows, dictionaries with ``target`` and ``command`` (text) and
any further columns. Plans are as small as the code that they come from; tables
of data have the operators in ``rivulet.operators.planalgebra``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Sequence

from rivulet.functions.names import make_unique, sanitize

Row = dict[str, str]


def evaluate_plan(plan: list[Row], rules: dict[str, Sequence], expand: bool = True, rename: bool | None = None, trace: bool = False) -> list[Row]:
    """The plan with wildcards in its commands replaced by values.

    With ``expand``, a target whose command holds wildcards is repeated for every
    combination of the values of those it holds, the first wildcard varying slowest.
    Without, each wildcard goes through its targets and hands them its values in
    turn, again from the start when there are fewer. ``rename`` (by default what
    ``expand`` is) adds the values to the names. ``trace`` adds a column for each wildcard.
    """
    rename = expand if rename is None else rename
    if any(not len(values) for values in rules.values()):
        raise ValueError("a wildcard needs values")
    rows = [dict(r) for r in plan]
    if expand:
        out = []
        for row in rows:
            held = [w for w in rules if w in row["command"]]
            out += [_filled(row, dict(zip(held, values, strict=True)), rename, trace) for values in itertools.product(*(rules[w] for w in held))]
    else:
        turns = {w: itertools.cycle(values) for w, values in rules.items()}
        out = [_filled(row, {w: next(turns[w]) for w in rules if w in row["command"]}, rename, trace) for row in rows]
    for row, name in zip(out, make_unique([r["target"] for r in out]), strict=True):
        row["target"] = name
    return out


def _filled(row: Row, values: dict[str, object], rename: bool, trace: bool) -> Row:
    row = dict(row)
    for wildcard, value in values.items():
        row["command"] = row["command"].replace(wildcard, str(value))
    if rename and values:
        row["target"] = sanitize("_".join([row["target"], *map(str, values.values())]))
    if trace:
        row |= {w: str(v) for w, v in values.items()}
    return row


def expand_plan(plan: list[Row], values: Sequence, rename: bool = True) -> list[Row]:
    """Every target once for each value; commands stay as they are."""
    return [{**r, "target": sanitize(f"{r['target']}_{v}") if rename else r["target"]} for r in plan for v in values]


def reduce_plan(plan: list[Row], target: str = "target", begin: str = "", op: str = " + ", end: str = "", pairwise: bool = True) -> list[Row]:
    """Targets that reduce those of the plan to one.

    Pairwise, each step joins two neighbours and the steps form a tree as shallow as can be,
    so they can run side by side; the last one is called ``target``. Otherwise one
    command joins all.
    """
    names = [r["target"] for r in plan]
    if not pairwise or len(names) < 2:
        return [{"target": target, "command": begin + op.join(names) + end}] if names else []
    out: list[Row] = []
    while len(names) > 1:
        level, names = names, []
        for left, right in itertools.zip_longest(level[::2], level[1::2]):
            if right is None:
                names.append(left)
                continue
            name = target if len(level) == 2 else f"{target}_{len(out) + 1}"
            out.append({"target": name, "command": begin + left + op + right + end})
            names.append(name)
    return out


def _groups(plan: list[Row], by: Iterable[str], keep: Callable[[Row], bool] | None) -> dict[tuple, list[Row]]:
    found: dict[tuple, list[Row]] = {}
    for r in plan:
        if keep is None or keep(r):
            found.setdefault(tuple(r.get(c) for c in by), []).append(r)
    return found


def reduce_by(plan: list[Row], *by: str, prefix: str = "reduced", begin: str = "", op: str = " + ", end: str = "", pairwise: bool = True, append: bool = True, keep: Callable[[Row], bool] | None = None) -> list[Row]:
    """A reduction for each group of targets that are equal in the columns ``by``, after the plan itself with ``append``."""
    out = list(plan) if append else []
    for key, rows in _groups(plan, by, keep).items():
        name = sanitize("_".join([prefix, *map(str, key)]))
        out += [{**step, **dict(zip(by, key, strict=True))} for step in reduce_plan(rows, name, begin, op, end, pairwise)]
    return out


def gather_plan(plan: list[Row], target: str = "gathered", call: str = "list") -> list[Row]:
    """One target that names all others."""
    return [{"target": target, "command": f"{call}({', '.join(f'{r['target']} = {r['target']}' for r in plan)})"}] if plan else []


def plan_analyses(analyses: list[Row], datasets: list[Row], wildcard: str = "dataset__") -> list[Row]:
    """Every analysis for every data set that its command leaves open."""
    return evaluate_plan(analyses, {wildcard: [r["target"] for r in datasets]}, trace=True)


def plan_summaries(summaries: list[Row], analyses: list[Row], datasets: list[Row], call: str | None = "list") -> list[Row]:
    """Every summary of every analysis (``analysis__``) and of its data set (``dataset__``), and a target that gathers each kind.

    With ``call=None`` nothing is gathered.
    """
    out: list[Row] = []
    names = {r["target"] for r in datasets}
    for s in summaries:
        if "analysis__" not in s["command"]:
            raise ValueError(f"{s['target']} does not say of which analysis__ it is")
        made = []
        for a in analyses:
            data = a.get("dataset__") or next((n for n in sorted(names) if n in a["command"]), "")
            made.append({"target": sanitize(f"{s['target']}_{a['target']}"), "command": s["command"].replace("analysis__", a["target"]).replace("dataset__", data)})
        out += ([{"target": s["target"], "command": f"{call}({', '.join(f'{m['target']} = {m['target']}' for m in made)})"}] if call else []) + made
    return out
