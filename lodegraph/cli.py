"""Command line: python -m lodegraph.cli COMMAND. Prints JSON lines."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from .api import Lodegraph, NotFound, records
from .sources.tree import Config

#: Rows that the commands show.
SHOWN = {"search": 30, "callers": 50}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegraph")
    p.add_argument("--project", default=".")
    p.add_argument("--warehouse", default=os.environ.get("LODEGRAPH_WAREHOUSE", os.path.expanduser("~/.lodegraph")))
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "stats", "watch"):
        sub.add_parser(name)
    for name in ("context", "impact", "callers", "flow"):
        sub.add_parser(name).add_argument("target", help="FILE::SYMBOL")
    for name in ("summary", "dependencies", "dependents"):
        sub.add_parser(name).add_argument("path")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--kind")
    s = sub.add_parser("scan")
    s.add_argument("path", nargs="?")
    s.add_argument("--all", action="store_true")
    s.add_argument("--diff", metavar="COMMITS")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    """0 if all went well, 1 if something is missing, 2 if a scan of a file or a range of commits blocks."""
    a = _parser().parse_args(args)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lodegraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    g = Lodegraph(spark, os.path.abspath(a.project), a.warehouse, Config.load(a.config) if a.config else None)
    show = lambda x: print(json.dumps(x, default=str))
    path, _, symbol = getattr(a, "target", "").rpartition("::")
    try:
        if a.command == "index":
            show(vars(g.index()))
        elif a.command == "stats":
            show(records(g.stats())[0])
        elif a.command in ("context", "impact"):
            show(getattr(g, a.command)(path, symbol))
        elif a.command == "callers":
            for r in records(g.callers(path, symbol).limit(SHOWN["callers"])):
                show(r)
        elif a.command == "flow":
            show(g.data_flow(path, symbol))
        elif a.command == "summary":
            show(g.module_summary(a.path))
        elif a.command == "dependencies":
            show(g.dependencies(a.path))
        elif a.command == "dependents":
            for r in records(g.dependents(a.path)):
                show(r)
        elif a.command == "search":
            for r in records(g.search(a.query, a.kind).limit(SHOWN["search"])):
                show(r)
        elif a.command == "scan":
            return _scan(g, a, show)
        elif a.command == "watch":
            from .streaming.watch import watch

            query = watch(spark, g.store, g.project, f"{g.store.path}/watch-{int(time.time())}", g.config.debounce_ms, lambda r: show(vars(r)))
            query.awaitTermination()
    except (NotFound, FileNotFoundError) as e:
        print(json.dumps({"error": f"not found: {e}"}), file=sys.stderr)
        return 1
    return 0


def _scan(g: Lodegraph, a: argparse.Namespace, show) -> int:
    if a.all or a.diff:
        found = records((g.scan_commits(a.diff) if a.diff else g.scan_all()).orderBy("file_path", "line_number").drop("line", "rule"))
        for r in found:
            show(r)
        return 2 if a.diff and any(r["severity"] == "BLOCK" for r in found) else 0
    if not a.path:
        raise FileNotFoundError("name a file, --all or --diff")
    report = g.scan_file(a.path)
    show(report)
    return 2 if report["status"] == "BLOCK" else 0


if __name__ == "__main__":
    sys.exit(main())
