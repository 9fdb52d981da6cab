"""Lookups over the stored tables. Orders are explicit: (path, ordinal) where insertion order would otherwise show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEARCH_LIMIT = 50
DOC_CHARS = 120


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).limit(1)


def file_by_id(files: DataFrame, id_: str) -> DataFrame:
    return files.where(F.col("id") == id_).limit(1)


def symbols_for_file(symbols: DataFrame, file_id: str) -> DataFrame:
    return symbols.where(F.col("file_id") == file_id).orderBy("ordinal", "id")


def symbol_by_id(symbols: DataFrame, id_: str) -> DataFrame:
    return symbols.where(F.col("id") == id_)


def find_symbols(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    found = symbols.where(F.col("name") == name)
    return found.where(F.col("kind") == kind) if kind else found


def like(column, query: str):
    """Substring match that ignores the case of ASCII letters; % and _ in the query stay wildcards and nothing escapes."""
    return F.call_function("like", F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"%{_lower(query)}%".replace("\\", "\\\\")))


def _lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def search_symbols(symbols: DataFrame, files: DataFrame, query: str, kind: str | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Matches with their file's path ("" if it is gone), a score of 1.0 and the head of the docstring (null if empty)."""
    found = symbols.where(like(F.col("name"), query))
    found = found.where(F.col("kind") == kind) if kind else found
    joined = found.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id", "left")
    top = joined.withColumn("file_path", F.coalesce("file_path", F.lit(""))).orderBy("file_path", "ordinal", "id").limit(limit)
    head = F.substring("docstring", 1, DOC_CHARS)
    return top.select("id", "name", "kind", "file_path", "line_start", "signature", F.when(head != "", head).alias("docstring"), F.lit(1.0).alias("score"))


def pick(symbols: DataFrame) -> DataFrame:
    """One symbol for each (file_id, name): the first function or class, else the first."""
    order = Window.partitionBy("file_id", "name").orderBy(F.desc(F.col("kind").isin("function", "class")), "ordinal", "id")
    return symbols.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def find_symbol(files: DataFrame, symbols: DataFrame, path: str, name: str) -> DataFrame:
    """The picked symbol of a file; no row if the file or the symbol is missing."""
    inside = file_by_path(files, path).select(F.col("id").alias("file_id"))
    return pick(symbols.where(F.col("name") == name).join(inside, "file_id", "left_semi"))


def edges_from(edges: DataFrame, id_: str, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("from_id") == id_)
    return found.where(F.col("kind") == kind) if kind else found


def edges_to(edges: DataFrame, id_: str, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("to_id") == id_)
    return found.where(F.col("kind") == kind) if kind else found


def edges_for_file(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("file_path") == path)


def open_issues(issues: DataFrame, file_id: str) -> DataFrame:
    return issues.where((F.col("file_id") == file_id) & ~F.col("resolved"))


def session_events(events: DataFrame, session_id: str) -> DataFrame:
    return events.where(F.col("session_id") == session_id).orderBy("created_at", "seq")


def languages(files: DataFrame) -> DataFrame:
    """One row: the distinct languages, sorted."""
    return files.agg(F.array_sort(F.collect_set("language")).alias("languages"))
