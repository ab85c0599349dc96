"""Command line: ``python -m rivulet COMMAND SCRIPT STORE [TARGET...]``.

SCRIPT is a Python file that defines ``plan(spark)``. The command runs in this
fresh process: make, build, outdated, missed, recoverable, graph, deps,
predict, history or progress.
"""

from __future__ import annotations

import argparse
import runpy

from pyspark.sql import SparkSession

from rivulet.plans import introspect
from rivulet.plans.engine import Engine
from rivulet.sources.store import Store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rivulet", description=__doc__)
    parser.add_argument("command", choices=["make", "build", "outdated", "missed", "recoverable", "graph", "deps", "predict", "history", "progress", "clean", "gc", "unlock"])
    parser.add_argument("script")
    parser.add_argument("store")
    parser.add_argument("targets", nargs="*")
    parser.add_argument("--jobs", type=int, default=1)
    parser.add_argument("--keep-going", action="store_true")
    parser.add_argument("--recover", action="store_true")
    parser.add_argument("--format", choices=["text", "dot", "mermaid"], default="text")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(runpy.run_path(args.script)["plan"](spark), Store(spark, args.store))
    match args.command:
        case "make":
            print(engine.make(args.targets or None, args.jobs, args.keep_going, args.recover))
        case "build":
            print(*(f"{t}: {engine.build(t)}" for t in args.targets), sep="\n")
        case "outdated" | "missed" | "recoverable":
            print(*getattr(engine, args.command)(), sep="\n")
        case "graph":
            print({"text": introspect.to_text, "dot": introspect.to_dot, "mermaid": introspect.to_mermaid}[args.format](*introspect.graph_info(engine)))
        case "deps":
            for t in args.targets:
                introspect.deps_table(engine, t).show(truncate=False)
        case "predict":
            seconds, rows = introspect.predict(engine, args.jobs)
            print(seconds)
            rows.show(truncate=False)
        case "history":
            engine.store.history().show(1000, truncate=False)
        case "progress":
            engine.store.progress().show(1000, truncate=False)
        case "clean":
            engine.store.clean(*args.targets)
        case "gc":
            print(*engine.store.gc(), sep="\n")
        case "unlock":
            engine.store.unlock()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
