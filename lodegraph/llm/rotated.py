"""Near-duplicate vectors by cosine: randomised-rotation binary codes decide which pairs need exact recomputation.

Distinct vectors are dealt to the cells of sampled pivots. A vector also visits every other cell that could hold one of its links
(for unit vectors u, v in the cells of p, q with cos(u, v) >= t: cos(u, q) >= cos(u, p) - sqrt(2 - 2 t) * |p - q|), so
no link is lost. Each vector has a stored code, the signs of its rotation, one bit for each dimension, and a
stored correction factor, the inner product of the unit vector with its unit code. In a tile of a cell the inner product of a code and a
rotated partner, over the factor, is an unbiased estimate of the cosine; its error is at most
sqrt(1 - factor^2) / factor * sqrt(1 - code^2), so pairs whose upper bound is below the threshold are settled and all
others are recomputed in double precision.

Equal vectors are one node and count as links of each other. Vectors that are null, zero, or hold null or non-finite components
link with nothing; so do vectors of different lengths with each other. Rows with a null id keep a null component and count as
others' links. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

THRESHOLD = 0.9
#: Vectors for each pivot, and pivots at most: they are all that reaches the driver.
PER_PIVOT, MOST_PIVOTS = 16_384, 4096
#: Native or visiting vectors of a tile side: what a vector is sent to grows with the vectors over this.
SIDE = 16_384
SEED = 20
_SLACK = 1e-6


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and their correction factors."""
    turned = unit @ turn.T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def unpacked(bits: np.ndarray, dim: int) -> np.ndarray:
    """Unit code vectors."""
    return ((np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.sqrt(dim)).astype(np.float32)


def estimates(bits: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of coded rows with rotated unit columns, and bounds of their errors."""
    inner = unpacked(bits, turned.shape[1]) @ turned.T.astype(np.float32)
    error = (np.sqrt(np.maximum(0, 1 - factor**2)) / factor).astype(np.float32)[:, None] * np.sqrt(np.maximum(0, 1 - inner * inner))
    return inner / factor.astype(np.float32)[:, None], error


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with each of y, in double precision."""
    return (x @ y.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :])


def interval(factor: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a code's inner product must lie for the bounds of its estimate to admit the threshold.

    The estimate plus its greatest error is the cosine of the difference of two angles, that of the coded vector with its code and that of
    its partner with the code, so the bounds invert to an interval for each coded vector.
    """
    own, most = np.arccos(np.clip(factor, -1, 1)), np.arccos(threshold)
    return np.cos(np.minimum(np.pi, own + most)), np.cos(np.maximum(0, own - most))


def tile(x: np.ndarray, bits: np.ndarray, factor: np.ndarray, y: np.ndarray, turn: np.ndarray, threshold: float, within: bool, strip: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with cosine >= threshold, by the codes and factors of x; within: y is x and each pair is found once, i < j."""
    unit_y = y / np.sqrt((y * y).sum(1))[:, None]
    low, high = (v.astype(np.float32)[:, None] for v in interval(factor, threshold))
    turned = np.ascontiguousarray((unit_y @ turn.T).astype(np.float32).T)
    rows, cols = [], []
    for a in range(0, len(x), strip):
        skip = a if within else 0
        inner = unpacked(bits[a : a + strip], x.shape[1]) @ turned[:, skip:]
        near = inner >= low[a : a + strip] - np.float32(1e-4)
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        keep = inner[i, j] <= high[a + i, 0] + np.float32(1e-4)
        i, j = i[keep], j[keep] + skip
        if within:
            i, j = i[j > i + a], j[j > i + a]
        if len(i) > near.size // 16:  # dense: all cosines of the strip at once
            good = cosine(x[a : a + strip], y)[i, j] >= threshold
        else:
            u, v = x[a + i], y[j]
            good = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v))) >= threshold
        rows.append(i[good] + a)
        cols.append(j[good])
    return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(cols) if cols else np.zeros(0, int)


def raw_vectors(v: np.ndarray) -> list[bytes]:
    """Rows as 32-bit numbers if those hold them exactly, else as 64-bit ones."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    exact = (short == v).all(1)
    return [(short[k] if x else v[k].astype("<f8")).tobytes() for k, x in enumerate(exact.tolist())]


def read_vectors(raw: list[bytes], dim: int) -> np.ndarray:
    if all(len(x) == 4 * dim for x in raw):
        return np.frombuffer(b"".join(raw), "<f4").reshape(-1, dim).astype(float)
    return np.array([np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8") for x in raw], float).reshape(-1, dim)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that links reach, for each of n items."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if np.array_equal(before, low):
            break
    return low


def _pivots(nodes: DataFrame, count: int) -> np.ndarray:
    """At most MOST_PIVOTS distinct vectors, by a hash of their ids."""
    most = min(MOST_PIVOTS, max(1, count // PER_PIVOT))
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(most).collect()
    v = np.array([r["vector"] for r in rows], float)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _cells(nodes: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """cell, native, and the node with its code and factor, for its own cell and each lower-numbered one that it may have links in."""
    turn = rotation(pivots.shape[1])
    reach = float(np.sqrt(2 - 2 * threshold))
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T)) * reach + _SLACK

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                v = np.array(batch.column(2).flatten(), float).reshape(batch.num_rows, -1)
                near = v @ pivots.T / np.sqrt((v * v).sum(1))[:, None]
                home = near.argmax(1)
                gap = near[np.arange(len(v)), home][:, None] - near
                visit = (gap <= apart[home]) & (np.arange(len(pivots))[None, :] < home[:, None])
                r, c = np.nonzero(visit)
                row = np.concatenate([np.arange(len(v)), r])
                cell = np.concatenate([home, c])
                native = np.concatenate([np.ones(len(v), bool), np.zeros(len(r), bool)])
                bits, factor = codes(v / np.sqrt((v * v).sum(1))[:, None], turn)
                columns = [batch.column(0), batch.column(1), pa.array(raw_vectors(v), pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(factor)]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(native), *(c.take(pa.array(row)) for c in columns)], ["cell", "native", "node", "copies", "vector", "code", "factor"])

    return nodes.mapInArrow(deal, "cell long, native boolean, node long, copies long, vector binary, code binary, factor double")


def _comparer(dim: int, threshold: float):
    """Compares the two sides of a tile: links of each node, and the smallest node that links reach inside the tile."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        turn = rotation(dim)
        block = block.sort_values("node")
        visit = bool(block["visit"].iloc[0])
        i_, j_ = int(block["i"].iloc[0]), int(block["j"].iloc[0])
        if visit:
            left, right = block[block["native"]], block[~block["native"]]
        elif i_ == j_:
            left = right = block
        else:
            left, right = block[block["at"] == i_], block[block["at"] == j_]
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "other": [], "links": []}, dtype="int64")
        x, y = (read_vectors(s["vector"].tolist(), dim) for s in (left, right))
        bits = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
        i, j = tile(x, bits, left["factor"].to_numpy(), y, turn, threshold, within=not visit and i_ == j_)
        ids = np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()])
        copies = np.concatenate([left["copies"].to_numpy(), right["copies"].to_numpy()])
        off = 0 if left is right else len(left)
        links = np.bincount(i, copies[j + off], len(ids)) + np.bincount(j + off, copies[i], len(ids))
        low = spanning(len(ids), i, j + off)
        at = np.flatnonzero(links)
        return pd.DataFrame({"node": ids[at], "other": ids[low[at]], "links": links[at].astype("int64")})

    return compare


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links (other rows linked directly), component_id, kept (id_col = component_id) of every row."""
    spark = table.sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).withColumn("vector", F.when(good, F.transform("vector", lambda x: x + F.lit(0.0))))
    key = F.when(F.col("vector").isNotNull(), F.concat(F.hex(F.xxhash64("vector")), F.lit(":"), F.hex(F.xxhash64(F.lit(1), F.col("vector")))))
    rows = stored(rows.withColumn("key", key), "vectors")
    linked = rows.where("vector is not null")
    # equal vectors: a node is the smallest id, and a negative hash where no row has an id
    groups = linked.groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    groups = stored(groups, "groups")
    named = groups.where("node is not null")
    schema = "node long, other long, links long"
    parts = []
    for (dim,) in named.select(F.size("vector")).distinct().orderBy(F.size("vector")).collect():
        nodes = groups.where(F.size("vector") == dim).select(F.coalesce("node", -F.abs(F.xxhash64("key")) - 1).alias("node"), "copies", "vector")
        dealt = stored(_cells(nodes, _pivots(nodes, nodes.count()), threshold), "cells")
        # sides of about SIDE vectors: native ones meet each other and every visitor
        sized = dealt.groupBy("cell").agg(F.greatest(F.ceil(F.count_if("native") / SIDE), F.lit(1)).alias("natives"), F.greatest(F.ceil(F.count_if(~F.col("native")) / SIDE), F.lit(1)).alias("visitors"))
        spot = dealt.join(F.broadcast(sized), "cell").withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("native"), F.col("natives")).otherwise(F.col("visitors"))))
        among = F.transform(F.sequence(F.lit(0), F.col("natives") - 1), lambda x: F.struct(F.least(x, "at").alias("i"), F.greatest(x, "at").alias("j"), F.lit(False).alias("visit")))
        across = F.transform(F.sequence(F.lit(0), F.col("visitors") - 1), lambda x: F.struct(F.col("at").alias("i"), x.alias("j"), F.lit(True).alias("visit")))
        calls = F.transform(F.sequence(F.lit(0), F.col("natives") - 1), lambda x: F.struct(x.alias("i"), F.col("at").alias("j"), F.lit(True).alias("visit")))
        placed = spot.withColumn("tile", F.explode(F.when(F.col("native"), F.concat(among, across)).otherwise(calls)))

        parts.append(placed.select("cell", "tile.i", "tile.j", "tile.visit", "native", "at", "node", "copies", "vector", "code", "factor").groupBy("cell", "i", "j", "visit").applyInPandas(_comparer(dim, threshold), schema))
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        found = found.unionByName(part)
    found = stored(found, "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("near"))
    component = connected_components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    # the smallest id of a component: nodes without one are negative and take no part
    real = groups.select("key", F.coalesce("node", -F.abs(F.xxhash64("key")) - 1).alias("node"), F.col("node").alias("least"), "copies")
    joined = real.join(counts, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    about = joined.join(least, "component").select("key", "copies", F.coalesce("near", F.lit(0)).alias("near"), "component_id")
    out = rows.join(about, "key", "left")
    whole = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("copies") - 1 + F.col("near"), F.lit(0)).alias("n_links"), whole.alias("component_id"), (F.col("id") == whole).alias("kept"))
