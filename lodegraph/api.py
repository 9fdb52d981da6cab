"""The engine as one object: index a tree, then ask. Answers are DataFrames; `records` turns one into plain values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cve, graph, lookups, parse, queries, scan
from .plans.incremental import IndexResult, UpdateResult, index, update
from .plans.session import Sessions
from .sources.store import Store, store_path
from .sources.tree import Config, git_changes, scan_tree


class NotFound(LookupError):
    """A file or symbol that the store doesn't have."""


def records(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


@dataclass
class Session:
    """Sessions bound to one id."""

    id: str
    sessions: Sessions

    def record_read(self, path: str, symbol: str) -> str:
        return self.sessions.record_read(self.id, path, symbol)

    def record_write(self, path: str, before: str | None, after: str) -> dict:
        return self.sessions.record_write(self.id, path, before, after)

    def context(self) -> dict:
        return self.sessions.context(self.id)

    def undo(self, steps: int = 1) -> list[str]:
        return self.sessions.undo(self.id, steps)


class Lodegraph:
    """A project folder and its stored graph."""

    def __init__(self, spark: SparkSession, project: str, warehouse: str, config: Config | None = None, registry: parse.Registry = parse.DEFAULT):
        self.spark, self.project, self.config, self.registry = spark, project.rstrip("/"), config or Config(), registry
        self.store = Store(spark, store_path(warehouse, project))

    @property
    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.store.read("files"), self.store.read("symbols"), self.store.read("edges")

    def index(self) -> IndexResult:
        return index(self.store, scan_tree(self.spark, self.project, self.config), self.registry)

    def update(self, paths: list[str] | None = None, resolve_all: bool = False) -> UpdateResult:
        """Files that are given, or all, by checksum; given ones that are gone are removed."""
        now = scan_tree(self.spark, self.project, self.config)
        if paths is None:
            gone = self.store.read("files").join(now, "path", "left_anti").select("path")
        else:
            given = self.spark.createDataFrame([(p,) for p in paths], "path string")
            now = now.join(F.broadcast(given), "path", "left_semi")
            gone = given.join(now, "path", "left_anti")
        return update(self.store, now, gone, self.registry, resolve_all)

    def stats(self) -> DataFrame:
        return queries.stats(*self.tables)

    def file_map(self) -> DataFrame:
        files, symbols, _ = self.tables
        return queries.file_map(files, symbols).orderBy("path")

    def search(self, query: str, kind: str | None = None) -> DataFrame:
        files, symbols, _ = self.tables
        return lookups.search_symbols(symbols, files, query, kind)

    def _one(self, df: DataFrame, what: str) -> dict:
        row = df.first()
        if row is None:
            raise NotFound(what)
        return row.asDict(recursive=True)

    def context(self, path: str, symbol: str, depth: int = 2) -> dict:
        return self._one(queries.context(*self.tables, path, symbol, depth), f"{path}::{symbol}")

    def impact(self, path: str, symbol: str) -> dict:
        return self._one(queries.impact(*self.tables, path, symbol), f"{path}::{symbol}")

    def module_summary(self, path: str) -> dict:
        files, symbols, _ = self.tables
        return self._one(queries.module_summary(files, symbols).where(F.col("path") == path), path)

    def callers(self, path: str, symbol: str) -> DataFrame:
        return queries.callers_of(*self.tables, path, symbol)

    def callees(self, path: str, symbol: str) -> DataFrame:
        return queries.callees_of(*self.tables, path, symbol)

    def dependencies(self, path: str) -> dict:
        files, symbols, _ = self.tables
        return self._one(queries.dependencies(files, symbols, path), path)

    def dependents(self, path: str) -> DataFrame:
        return queries.dependents(*self.tables, path)

    def data_flow(self, path: str, symbol: str) -> dict:
        rows = self.data_flow_rows(path, symbol).orderBy("role", "pos").collect()
        sources, sinks = ([r["name"] for r in rows if r["role"] == role] for role in ("source", "sink"))
        shown = [[r["name"], symbol] if r["role"] == "source" else [symbol, r["name"]] for r in sorted(rows, key=lambda r: r["role"] == "sink") if r["on_path"]]
        return {"sources": sources, "sinks": sinks, "paths": shown, "intermediates": []}

    def data_flow_rows(self, path: str, symbol: str) -> DataFrame:
        return queries.data_flow(*self.tables, path, symbol)

    def paths(self, start: str, end: str, cutoff: int = 6) -> DataFrame:
        return graph.simple_paths(self.store.read("edges"), start, end, cutoff)

    def export_json(self) -> DataFrame:
        files, symbols, edges = self.tables
        nodes = symbols.unionByName(files.select("id", F.lit("file").alias("kind"), "path"), allowMissingColumns=True)
        return graph.json_rows(nodes, edges)

    def scan_all(self) -> DataFrame:
        """Findings of every source file that is valid UTF-8."""
        return scan.scan(scan_tree(self.spark, self.project, self.config, strict=True).withColumnRenamed("path", "file_path"))

    def scan_file(self, path: str, content: str | None = None) -> dict:
        if content is None:
            with open(path, encoding="utf-8") as f:
                content = f.read()
        return self._report(scan.scan(self.spark.createDataFrame([(path, content)], "file_path string, content string")))

    def scan_secrets(self, content: str) -> dict:
        return self._report(scan.scan(self.spark.createDataFrame([("", content)], "file_path string, content string"), detectors=("secrets",)))

    def scan_diff(self, before: str, after: str, path: str = "") -> dict:
        return self._report(scan.scan_diff(self.spark.createDataFrame([(path, before, after)], "file_path string, before string, after string")))

    def scan_commits(self, commits: str) -> DataFrame:
        return scan.scan_diff(git_changes(self.spark, self.project, commits))

    def _report(self, findings: DataFrame) -> dict:
        rows = records(findings.orderBy("detector", "line_number", "rule").drop("line", "rule"))
        worst = {r["severity"] for r in rows}
        return {"status": "BLOCK" if "BLOCK" in worst else "WARN" if "WARN" in worst else "PASS", "issues": rows}

    def check_requirements(self, text: str, advisories: DataFrame) -> dict:
        found = cve.check(cve.requirements(self.spark.createDataFrame([(text,)], "text string")), advisories)
        return {"status": cve.status(found).first()["status"], "packages": records(cve.vulnerable(found))}

    def session(self, id_: str) -> Session:
        return Session(id_, Sessions(self.store, self.project))
