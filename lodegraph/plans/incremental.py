"""Indexing and updates: scan, parse, resolve, and merge by checksum into a new version of the store."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import parse as P
from ..operators.queries import index_totals, stats
from ..operators.resolve import resolve_global
from ..sources.store import Store
from .storage import cut


@dataclass
class IndexResult:
    """errors: the first ones; all n_errors are in the stored table `errors`."""

    file_count: int
    symbol_count: int
    edge_count: int
    errors: list[str]
    seconds: float
    n_errors: int = 0


@dataclass
class UpdateResult:
    """Files by change, symbols of changed files after and before, and edges made."""

    changes: dict[str, int]
    nodes_added: int
    nodes_removed: int
    edges_updated: int


def classify_changes(old: DataFrame, new: DataFrame, path: str = "path", checksum: str = "checksum") -> DataFrame:
    """(path, change): added, modified, removed, or skipped where the checksum is the same."""
    a = old.select(F.col(path).alias("_old"), F.col(checksum).alias("_a"))
    b = new.select(F.col(path).alias("_new"), F.col(checksum).alias("_b"))
    change = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(F.col("_a") == F.col("_b"), "skipped").otherwise("modified")
    return a.join(b, F.col("_old") == F.col("_new"), "full_outer").select(F.coalesce("_new", "_old").alias("path"), change.alias("change"))


def index(store: Store, files: DataFrame, registry: P.Registry = P.DEFAULT, shown_errors: int = 1000) -> IndexResult:
    """Index a tree (path, content, last_modified) into a fresh version. Rows of files that are gone are dropped, and so are old symbols of changed ones."""
    begun = time.time()
    parsed = cut(P.parse_files(files, registry))
    f, s, e, r = P.files_of(parsed), P.symbols_of(parsed).drop("path"), P.edges_of(parsed), P.refs_of(parsed)
    edges = e.unionByName(resolve_global(r, s, f)).dropDuplicates(["id"])
    store.write({"files": f, "symbols": s, "edges": edges, "refs": r, "errors": parsed.where("error IS NOT NULL").select("path", "error")})
    got = index_totals(stats(store.read("files"), store.read("symbols"), store.read("edges"))).first()
    broken = store.read("errors")
    errors = [x["error"] for x in broken.orderBy("error").limit(shown_errors).collect()]
    return IndexResult(got["file_count"], got["symbol_count"], got["edge_count"], errors, time.time() - begun, broken.count())


def update(store: Store, files: DataFrame, removed: DataFrame | None = None, registry: P.Registry = P.DEFAULT, resolve_all: bool = False) -> UpdateResult:
    """Apply changed files (path, content, last_modified) and removed paths in one batch.

    Files whose checksum is the same are skipped before parsing. Symbols of changed files, and edges whose referrer is in them, are
    replaced. Edges into a changed file from others stay, as the stored tables are the truth. resolve_all tries every stored
    open reference again, so that new symbols are found from files that didn't change.
    """
    from ..functions.columns import checksum

    old_f, old_s, old_e, old_r = (store.read(t) for t in ("files", "symbols", "edges", "refs"))
    now = files.withColumn("checksum", checksum(F.coalesce("content", F.lit(""))))
    given = now.select("path", "checksum")
    change = classify_changes(old_f.join(given.select("path"), "path", "left_semi"), given)
    dirty = cut(change.where("change IN ('added', 'modified')").select("path"))
    parsed = cut(P.parse_files(now.join(dirty, "path", "left_semi"), registry))
    gone = old_f.join(removed.select("path"), "path", "left_semi").select("path") if removed is not None else old_f.select("path").limit(0)
    out = dirty.union(gone).distinct()
    out_ids = old_f.join(out, "path", "left_semi").select(F.col("id").alias("file_id"))
    new_f, new_s, new_e, new_r = P.files_of(parsed), P.symbols_of(parsed).drop("path"), P.edges_of(parsed), P.refs_of(parsed)
    kept_s, kept_f = old_s.join(out_ids, "file_id", "left_anti"), old_f.join(out, "path", "left_anti")
    paths = out.select(F.col("path").alias("file_path"))
    all_s, all_f = kept_s.select(*new_s.columns).unionByName(new_s), kept_f.select(*new_f.columns).unionByName(new_f)
    kept_r = old_r.join(paths, "file_path", "left_anti")
    all_r = kept_r.select(*new_r.columns).unionByName(new_r)
    made = new_e.unionByName(resolve_global(all_r if resolve_all else new_r, all_s, all_f)).dropDuplicates(["id"])
    made = cut(made)
    kept_e = old_e.join(paths, "file_path", "left_anti").join(made.select("id"), "id", "left_anti")
    counts = {x["change"]: x["count"] for x in change.groupBy("change").count().collect()}
    counts["removed"] = gone.count()
    result = UpdateResult(counts, new_s.count(), old_s.join(out_ids, "file_id", "left_semi").count(), made.count())
    if counts.get("added") or counts.get("modified") or counts["removed"] or resolve_all:
        errors = store.read("errors").join(out, "path", "left_anti").unionByName(parsed.where("error IS NOT NULL").select("path", "error"))
        store.write({"files": all_f, "symbols": all_s, "edges": kept_e.select(*made.columns).unionByName(made), "refs": all_r, "errors": errors})
    return result
