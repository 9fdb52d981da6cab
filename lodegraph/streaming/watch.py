"""Watching a tree: a polling stream source, a debounce by path, and updates in batches."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.parse import DEFAULT
from ..sources.store import Store

DEBOUNCE_MS = 500
DEAD = "path string, error string, at double"


class _Poll(SimpleDataSourceStreamReader):
    """Offsets hold what was last seen; a read lists the tree and gives what differs."""

    def __init__(self, options: dict):
        self.root, self.suffixes = options["path"], tuple(json.loads(options.get("suffixes", "[]"))) or tuple(DEFAULT.supported())

    def _seen(self) -> dict[str, list]:
        out = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if name.lower().endswith(self.suffixes):
                    at = os.path.join(folder, name)
                    try:
                        s = os.stat(at)
                    except OSError:
                        continue
                    out[at] = [s.st_mtime_ns, s.st_size]
        return out

    def initialOffset(self) -> dict:
        return {"seen": json.dumps(self._seen()), "at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, new, now = json.loads(start["seen"]), self._seen(), time.time()
        rows = [(p, "created" if p not in old else "modified", now) for p in sorted(new) if old.get(p) != new[p]]
        rows += [(p, "deleted", now) for p in sorted(old) if p not in new]
        return iter(rows), {"seen": json.dumps(new), "at": start["at"] + 1} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        old, new = json.loads(start["seen"]), json.loads(end["seen"])
        rows = [(p, "created" if p not in old else "modified", 0.0) for p in sorted(new) if old.get(p) != new[p]]
        return iter(rows + [(p, "deleted", 0.0) for p in sorted(old) if p not in new])


class TreeChanges(DataSource):
    """Format tree_changes, option path: rows (path, change, at) when files below a folder appear, change or go."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return "path string, change string, at double"

    def simpleStreamReader(self, schema) -> _Poll:
        return _Poll(dict(self.options))


def bursts(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """Replay form of the debounce: one row for each path and burst, whose last change stands. events: path, ts, change, seq."""
    window = F.session_window("ts", gap)
    got = events.groupBy("path", window).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "seq", "change")).alias("last"))
    return got.select("path", "first_ts", "last_ts", "n", F.col("last.change").alias("change"))


def debounced(changes: DataFrame, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Live form: a path's last change once it has been quiet for so long, by processing time, also if nothing follows."""

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (change, at) = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "change": [change], "at": [at]})
            return
        for frame in frames:
            last = frame.iloc[-1]
            state.update((str(last["change"]), float(last["at"])))
        state.setTimeoutDuration(quiet_ms)

    return changes.groupBy("path").applyInPandasWithState(settle, "path string, change string, at double", "change string, at double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def apply_changes(store: Store, batch: DataFrame, on_update: Callable | None = None) -> None:
    """One batch of settled changes: read what is there, update the store, note what can't be read in the table `dead`."""
    from ..plans.incremental import update

    spark = store.spark
    rows, removed, dead = [], [], []
    for r in batch.select("path", "change").distinct().toLocalIterator():  # the settled paths of one trigger
        try:
            with open(r["path"], encoding="utf-8", errors="replace") as f:
                rows.append((r["path"], f.read(), os.path.getmtime(r["path"])))
        except FileNotFoundError:
            removed.append((r["path"],))
        except OSError as e:
            dead.append((r["path"], str(e), time.time()))
    if rows or removed:
        got = update(store, spark.createDataFrame(rows, "path string, content string, last_modified double"), spark.createDataFrame(removed, "path string"))
        if on_update and sum(n for k, n in got.changes.items() if k != "skipped"):
            on_update(got)
    if dead:
        spark.createDataFrame(dead, DEAD).write.mode("append").parquet(f"{store.path}/dead")


def watch(spark: SparkSession, store: Store, root: str, checkpoint: str, quiet_ms: int = DEBOUNCE_MS, on_update: Callable | None = None):
    """Starts the stream; stop() on what it returns ends it."""
    spark.dataSource.register(TreeChanges)
    changes = spark.readStream.format("tree_changes").option("path", root).load()
    return debounced(changes, quiet_ms).writeStream.foreachBatch(lambda batch, _: apply_changes(store, batch, on_update)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, quiet_ms // 4)} milliseconds").start()


