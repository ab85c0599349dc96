"""What is known about a plan and its store: graph, predictions, build times."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rivulet.plans import deps as d
from rivulet.plans.engine import Engine
from rivulet.plans.schedule import simulate

#: From the least to the most urgent; of several, the last one counts.
STATUSES = ("imported", "up to date", "missing", "outdated", "running", "cancelled", "failed")


def statuses(engine: Engine) -> dict[str, str]:
    stale, progress = set(engine.outdated()), {r["target"]: r["status"] for r in engine.store.progress().collect()}  # a plan's targets
    out = {}
    for n in engine.order:
        found = ["up to date"]
        if n in stale:
            found.append("outdated" if engine.store.meta(n) else "missing")
        if progress.get(n) in ("running", "cancelled", "failed"):
            found.append(progress[n])
        out[n] = max(found, key=STATUSES.index)
    return out


def graph_info(engine: Engine, start: set[str] | None = None, order: int | None = None, mode: str = "all", targets_only: bool = True, clusters: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Nodes: id, status, type, level, x, y, seconds, branches; edges: from, to.

    ``start``, ``order`` and ``mode`` (in, out, all) keep a neighbourhood;
    ``clusters`` names the group that each of its targets is drawn as.
    """
    edges, ids = list(engine.edges), list(engine.order)
    status, kind = statuses(engine), {n: "dynamic" if engine.plan[n].dynamic else "object" for n in ids}
    if not targets_only:
        for n in engine.order:
            for group, what in (("functions", "function"), ("file_in", "file"), ("file_out", "file")):
                for x in engine.deps[n][group]:
                    edges.append((n, x) if group == "file_out" else (x, n))
                    status.setdefault(x, "imported")
                    kind.setdefault(x, what)
                    ids += [x] * (x not in ids)
    if start is not None:
        near, frontier, steps = set(start), set(start), 0
        while frontier and (order is None or steps < order):
            new = set()
            if mode in ("out", "all"):
                new |= {b for a, b in edges if a in frontier}
            if mode in ("in", "all"):
                new |= {a for a, b in edges if b in frontier}
            frontier, steps = new - near, steps + 1
            near |= frontier
        ids = [n for n in ids if n in near]
    if clusters:
        of = {n: clusters.get(n, n) for n in ids}
        merged: dict[str, str] = {}
        for n in ids:
            merged[of[n]] = max(merged.get(of[n], "imported"), status[n], key=STATUSES.index)
            kind.setdefault(of[n], "cluster")
        edges = [(of[a], of[b]) for a, b in edges if a in of and b in of and of[a] != of[b]]
        ids, status = list(merged), merged
    edges = sorted({(a, b) for a, b in edges if a in ids and b in ids})
    level = dict.fromkeys(ids, 0)
    for _ in ids:
        for a, b in edges:
            level[b] = max(level[b], min(level[a] + 1, len(ids)))
    top = max(level.values(), default=0)
    rows = []
    for n in ids:
        same = sorted(x for x in ids if level[x] == level[n])
        x = -1.0 + 2.0 * level[n] / top if top else 0.0
        y = -1.0 + 2.0 * same.index(n) / (len(same) - 1) if len(same) > 1 else 0.0
        meta = engine.store.meta(n) or {}
        rows.append((n, status[n], kind.get(n, "object"), level[n], x, y, meta.get("elapsed"), meta.get("branches")))
    spark = engine.spark
    nodes = spark.createDataFrame(rows, "id string, status string, type string, level int, x double, y double, seconds double, branches long")
    return nodes, spark.createDataFrame(edges, "`from` string, `to` string")


#: The colour-blind-safe palette of M. Okabe and K. Ito, "Color Universal Design" (2008).
SKY, BLUE, GREEN, YELLOW, ORANGE, VERMILLION, PURPLE = "#56B4E9", "#0072B2", "#009E73", "#F0E442", "#E69F00", "#D55E00", "#CC79A7"


def legend() -> list[tuple[str, str]]:
    """(status, colour) of the drawings: calm colours for what is settled, warm ones for what needs work."""
    return list(zip(STATUSES, (SKY, GREEN, PURPLE, ORANGE, BLUE, YELLOW, VERMILLION), strict=True))


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    colour = dict(legend())
    lines = [f'  "{r["id"]}" [color="{colour[r["status"]]}", shape={"box" if r["type"] == "file" else "ellipse"}];' for r in nodes.collect()]
    lines += [f'  "{r["from"]}" -> "{r["to"]}";' for r in edges.collect()]
    return "digraph plan {\n  rankdir=LR;\n" + "\n".join(lines) + "\n}\n"


def to_mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    number = {r["id"]: f"n{i}" for i, r in enumerate(nodes.collect())}
    lines = [f'  {k}["{n}"]' for n, k in number.items()] + [f"  {number[r['from']]} --> {number[r['to']]}" for r in edges.collect()]
    return "flowchart LR\n" + "\n".join(lines) + "\n"


def to_text(nodes: DataFrame, edges: DataFrame) -> str:
    """Targets by level, each with what it depends on."""
    before: dict[str, list[str]] = {}
    for r in edges.collect():
        before.setdefault(r["to"], []).append(r["from"])
    rows = sorted(nodes.collect(), key=lambda r: (r["level"], r["id"]))
    return "".join(f"{'  ' * r['level']}{r['id']} ({r['status']})" + (f" <- {', '.join(sorted(before[r['id']]))}" if r["id"] in before else "") + "\n" for r in rows)


def build_times(engine: Engine, digits: int = 3) -> DataFrame:
    """(target, elapsed); a minute or more in whole seconds. Failed builds are left out."""
    from pyspark.sql import functions as F

    from rivulet.operators.records import build_seconds

    return engine.store.metas().where("error IS NULL AND elapsed IS NOT NULL").select("target", build_seconds(F.col("elapsed"), digits).alias("elapsed"))


def predict(engine: Engine, jobs: int = 1, from_scratch: bool = False, known_times: dict[str, float] | None = None, default_time: float = 0.0) -> tuple[float, DataFrame]:
    """(seconds, table of target, worker, start, end) of the next make."""
    times = {n: (engine.store.meta(n) or {}).get("elapsed") or default_time for n in engine.order} | (known_times or {})
    seconds, rows = simulate(engine.edges, {n: times[n] for n in engine.order}, jobs, default_time, None if from_scratch else set(engine.outdated()))
    table = [(r["target"], r["worker"], r["start"], r["end"]) for r in rows]
    return seconds, engine.spark.createDataFrame(table, "target string, worker int, start double, end double")


def deps_table(engine: Engine, name: str) -> DataFrame:
    """(name, type) of what a target depends on."""
    rows = [(x, k) for k, v in engine.deps[name].items() for x in sorted(v)]
    return engine.spark.createDataFrame(rows, "name string, type string")


def deps_of_report(path: str) -> list[tuple[str, str]]:
    """(name, type) of what the code of a report reads."""
    return [(n, "target") for n in d.report_targets(path)]


def deps_of_code(code) -> list[tuple[str, str]]:
    """(name, type) of what a function or SQL text mentions."""
    if isinstance(code, str):
        return sorted((n, "relation") for n in d.sql_relations(code))
    import inspect

    found = [(n, "function" if inspect.isfunction(v) else "module" if inspect.ismodule(v) else "value") for n, v in d.globals_of(code).items()]
    return sorted(found + [(f, k) for k in ("file_in", "file_out") for f in d.literal_calls(code, k)])
