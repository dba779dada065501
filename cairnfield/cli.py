"""python -m cairnfield.cli run | validate | nodes

Exit codes: 0 done; 1 the project can't be read or is wrong; 2 it is blocked, as inputs or files are missing;
3 the run failed. ``validate`` prints its findings as JSON, ``run --json`` a report, ``nodes --json`` all steps.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans.graph import Graph, over_files
from .plans.nodes import NODES

DONE, INVALID, BLOCKED, FAILED = range(4)


def _save(value, path: str) -> bool:
    cells = value[1] if isinstance(value, tuple) else value
    if isinstance(cells, DataFrame):
        cells.write.mode("overwrite").parquet(path)
        return True
    return False


def _load(path: str) -> tuple[Graph | None, list[str]]:
    try:
        return Graph.load(path).without_drafts(), []
    except (OSError, ValueError, KeyError, TypeError) as e:
        return None, [str(e) or type(e).__name__]


def _verdict(errors: list[str], blocks: list[str]) -> int:
    return INVALID if errors else BLOCKED if blocks else DONE


def _validate(path: str) -> int:
    graph, errors = _load(path)
    blocks = graph.blocks() if graph else []
    errors = graph.errors() if graph else errors
    about = {"project": path, "nodes": len(graph.nodes), "edges": len(graph.edges)} if graph else {}
    print(json.dumps({"valid": not errors and not blocks, **about, "errors": errors, "blocks": blocks}, indent=1))
    return _verdict(errors, blocks)


def _run(args) -> int:
    report: dict = {"status": "ok", "project": args.project, "products": [], "errors": []}
    graph, report["errors"] = _load(args.project)
    code = INVALID
    if graph:
        graph = graph.pruned(set(args.skip))
        graphs = over_files(graph, args.source) if args.source else [graph]
        errors, blocks = ([p for g in graphs for p in f(g)] for f in (Graph.errors, Graph.blocks))
        report["errors"], code = errors or blocks, _verdict(errors, blocks)
    if code == DONE:
        spark = SparkSession.builder.getOrCreate()
        try:
            for i, g in enumerate(graphs):
                ends = set(g.nodes) - {e.src for e in g.edges}
                for k, outputs in g.compile(spark).items():
                    for port, value in outputs.items() if k in ends else ():
                        path = f"{args.out}/{i if len(graphs) > 1 else ''}{k}.{port}.parquet"
                        if _save(value, path):
                            report["products"].append({"node": k, "name": port, "path": path})
        except Exception as e:
            report["errors"], code = [str(e)], FAILED
    report["status"] = ("ok", "invalid", "blocked", "failed")[code]
    if args.json:
        print(json.dumps(report, indent=1))
    elif report["errors"]:
        print("\n".join(report["errors"]), file=sys.stderr)
    return code


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairnfield")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("project")
    run.add_argument("--out", required=True)
    run.add_argument("--source", action="append", default=[])
    run.add_argument("--skip", action="append", default=[])
    run.add_argument("--json", action="store_true")
    check = sub.add_parser("validate")
    check.add_argument("project")
    steps = sub.add_parser("nodes")
    steps.add_argument("--json", action="store_true")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return INVALID if e.code else DONE
    if args.command == "run":
        return _run(args)
    if args.command == "validate":
        return _validate(args.project)
    if args.json:
        print(json.dumps([{"id": k, "inputs": n.inputs, "outputs": n.outputs, "settings": n.defaults} for k, n in sorted(NODES.items())], indent=1))
    else:
        print("\n".join(f"{k}  |  {', '.join(n.inputs.values()) or '-'}  ->  {', '.join(n.outputs.values()) or '-'}" for k, n in sorted(NODES.items())))
    return DONE


if __name__ == "__main__":
    sys.exit(main())
