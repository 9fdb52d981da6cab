"""Connected components of links, over DataFrames: no link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import stored

#: Keys that hold more than one in HOT_SHARE of all rows, so at most HOT_SHARE of them, are broadcast.
HOT_SHARE = 10_000


def looked_up(rows: DataFrame, key: str, table: DataFrame, n_table: int, name: str) -> DataFrame:
    """rows with a column `name`: the value p that table (v, p; each v once, n_table rows) gives for key, null without one.

    A small table is broadcast. Of a large one only the keys in use are joined, and the few hot ones among them are broadcast, so no key fills a task.
    """

    def joined(some: DataFrame, part: DataFrame, hint: bool) -> DataFrame:
        side = part.select(F.col("v").alias("_v"), F.col("p").alias(name))
        return some.join(F.broadcast(side) if hint else side, F.col(key) == F.col("_v"), "left").drop("_v")

    if n_table <= common.BROADCAST_ROWS:
        return joined(rows, table, True)
    used = rows.groupBy(F.col(key).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    used = stored(used.join(table, "v"), "used")
    total = rows.count()
    marked = joined(rows, used.where(F.col("n") * HOT_SHARE > total), True)
    cold = joined(marked.where(F.col(name).isNull()).drop(name), used.where(F.col("n") * HOT_SHARE <= total), False)
    return marked.where(F.col(name).isNotNull()).unionByName(cold)


def _rooted(parent: DataFrame) -> tuple[DataFrame, int]:
    """v, p with p moved up until it is a root, by doubling; and how many there are."""
    parent = stored(parent, "roots")
    n = parent.count()
    while True:
        jumped = stored(looked_up(parent, "p", parent, n, "up").select("v", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("moved")), "roots")
        parent = jumped.select("v", "p")
        if jumped.where("moved").limit(1).count() == 0:
            return parent, n


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) of every node in links (columns u, v, of one type).

    Each round hangs every node under its smallest neighbour, flattens the trees and contracts them; links inside a tree go.
    Nodes without links are not in the result. Null ends and self links count as no link.
    """
    pairs = links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    label = None
    while True:
        if edges.limit(1).count() == 0:
            break
        root, n = _rooted(edges.groupBy("v").agg(F.min("u").alias("p")))
        if label is None:
            nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
            label = nodes.withColumn("component", F.col("node"))
        label = stored(looked_up(label, "component", root, n, "up").select("node", F.coalesce("up", "component").alias("component")), "labels")
        moved = looked_up(looked_up(edges, "u", root, n, "pu"), "v", root, n, "pv").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"))
        edges = stored(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    return label if label is not None else edges.select(F.col("u").alias("node"), F.col("u").alias("component"))
