"""The journal of a session: reads, guarded writes, context, undo."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan
from ..sources.store import Store
from .incremental import update


# Fixed value: the sentence that sums up a session.
SENTENCE = "Session '{}': {} read(s) across {} file(s), {} write(s) to {} file(s), {} undo(s)."


def journal_context(events: DataFrame) -> DataFrame:
    """One row for each session: counts, what was read (path::symbol, or the path where no symbol is named, in order, repeats kept), the distinct files written, a sentence."""
    kind = lambda k: F.col("event_type") == k
    read = F.when(F.coalesce("symbol_name", F.lit("")) == "", F.col("file_path")).otherwise(F.concat("file_path", F.lit("::"), "symbol_name"))
    got = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(kind("READ")).alias("n_reads"), F.count_if(kind("WRITE")).alias("n_writes"), F.count_if(kind("UNDO")).alias("n_undos"),
        F.array_sort(F.collect_list(F.when(kind("READ"), F.struct("created_at", "seq", read.alias("what"))))).alias("r"), F.count_distinct(F.when(kind("READ"), F.col("file_path"))).alias("k"), F.array_sort(F.collect_set(F.when(kind("WRITE"), F.col("file_path")))).alias("files_written"),
    )
    said = F.format_string(SENTENCE.replace("{}", "%s"), "session_id", "n_reads", "k", "n_writes", F.size("files_written"), "n_undos")
    return got.select("session_id", "total_events", "n_reads", "n_writes", "n_undos", F.transform("r", lambda x: x["what"]).alias("files_read"), "files_written", said.alias("summary"))


def undo_candidates(events: DataFrame, steps: int = 1) -> DataFrame:
    """The newest writes of each session, blocked ones among them, with their step and whether there is an old text to restore."""
    order = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("seq"))
    rows = events.where("event_type = 'WRITE'").withColumn("step", F.row_number().over(order)).where(F.col("step") <= steps)
    return rows.withColumn("restores", F.col("content_before").isNotNull())


@dataclass
class Sessions:
    """Sessions over a store and a project folder. Texts are written by the driver, one at a time, as an editor would."""

    store: Store
    root: str

    def _append(self, session: str, kind: str, path: str | None, symbol: str | None = None, before: str | None = None, after: str | None = None, report: str | None = None) -> str:
        spark = self.store.spark
        made = uuid.uuid4().hex
        row = [(made, session, kind, path, symbol, before, after, report, time.time(), time.time_ns())]
        self.store.append("events", spark.createDataFrame(row, self.store.schema("events")))
        return made

    def events(self, session: str) -> DataFrame:
        return self.store.read("events").where(F.col("session_id") == session).orderBy("created_at", "seq")

    def record_read(self, session: str, path: str, symbol: str) -> str:
        return self._append(session, "READ", path, symbol)

    def record_write(self, session: str, path: str, before: str | None, after: str) -> dict:
        """Scan what the change adds, journal it, and, unless it is blocked, write the file and update the store."""
        change = self.store.spark.createDataFrame([(path, before or "", after)], "file_path string, before string, after string")
        found = [r.asDict() for r in scan.scan_diff(change).select("line_number", "severity", "description", "fix_suggestion", "detector").orderBy("line_number", "rule").collect()]
        worst = {r["severity"] for r in found}
        status = "BLOCK" if "BLOCK" in worst else "WARN" if "WARN" in worst else "PASS"
        report = {"status": status, "file": path, "issues": found}
        self._append(session, "WRITE", path, None, before, after, json.dumps(report))
        changed = {"nodes_added": 0, "nodes_removed": 0, "edges_updated": 0}
        if status != "BLOCK":
            changed = self._write(path, after)
        return {**report, "graph_update": changed}

    def _write(self, path: str, text: str) -> dict:
        at = os.path.join(self.root, path)
        os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(text)
        row = self.store.spark.createDataFrame([(path, text, time.time())], "path string, content string, last_modified double")
        got = update(self.store, row)
        return {"nodes_added": got.nodes_added, "nodes_removed": got.nodes_removed, "edges_updated": got.edges_updated}

    def context(self, session: str) -> dict:
        got = journal_context(self.store.read("events").where(F.col("session_id") == session)).first()
        return got.asDict(recursive=True) if got else {"session_id": session, "total_events": 0, "n_reads": 0, "n_writes": 0, "n_undos": 0, "files_read": [], "files_written": [], "summary": SENTENCE.format(session, 0, 0, 0, 0, 0)}

    def undo(self, session: str, steps: int = 1) -> list[str]:
        """Restore the old texts of the newest writes; a write isn't marked by that, so another undo meets it again."""
        rows = undo_candidates(self.store.read("events").where(F.col("session_id") == session), steps).where("restores").orderBy("step").collect()
        for r in rows:
            self._write(r["file_path"], r["content_before"])
            self._append(session, "UNDO", r["file_path"], None, r["content_after"], r["content_before"])
        return [r["file_path"] for r in rows]
