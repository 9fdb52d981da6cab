"""Resolution of references to symbols: inside a file, then across files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import edge_id


def global_names(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """name, to_id: the last symbol of a name that isn't an import, else its first import, by path components and ordinal."""
    order = F.struct(F.split(F.col("path"), "/").alias("parts"), F.col("ordinal"), F.col("id"))
    placed = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    real, imported = F.col("kind") != "import", F.col("kind") == "import"
    best = F.coalesce(F.max(F.when(real, F.struct(order.alias("o"), F.col("id").alias("i"))))["i"], F.min(F.when(imported, F.struct(order.alias("o"), F.col("id").alias("i"))))["i"])
    return placed.groupBy("name").agg(best.alias("to_id"))


def as_edges(refs: DataFrame) -> DataFrame:
    """Edge rows of references with a to_id."""
    return refs.select(
        edge_id(F.col("from_id"), F.col("to_id"), F.col("kind"), F.col("line_number")).alias("id"), "kind", "from_id", "to_id", "file_path", F.col("line_number").cast("int").alias("line_number"), F.lit(1.0).alias("weight"), F.lit(False).alias("is_conditional")
    )


def resolve_global(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of references whose name any file defines; a reference to itself makes none.

    Names are pre-aggregated to one row each, so a name that many references share is a skewed probe at most, which the adaptive join splits.
    """
    found = refs.join(global_names(symbols, files), F.col("ref_name") == F.col("name")).where(F.col("to_id") != F.col("from_id"))
    return as_edges(found).dropDuplicates(["id"])


def resolve_local(refs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and what stays open. names: file_path, name, id, ordinal; the last of a name wins."""
    last = names.groupBy("file_path", "name").agg(F.max_by("id", "ordinal").alias("to_id"))
    joined = refs.join(last, (refs["ref_name"] == last["name"]) & (refs["file_path"] == last["file_path"]), "left").drop(last["file_path"])
    good = F.col("to_id").isNotNull() & (F.col("to_id") != F.col("from_id"))
    return as_edges(joined.where(good)).dropDuplicates(["id"]), joined.where(~F.coalesce(good, F.lit(False))).drop("name", "to_id")
