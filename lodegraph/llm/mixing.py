"""Mixing of sources to target weights by the cube method: balanced sampling of documents.

A document's expected number of copies is its source's target over its source's size. The whole part is taken as it is;
the fraction is an inclusion probability. The flight phase moves the probabilities of a block of documents along the
null space of two constraints, the totals of tokens and of documents, until at most two of them are not 0 or 1. A few
documents of each size class are reserved from the flight. What is left over from all blocks flies again in blocks of leftovers, so
only two documents of a source and its last reserve, at most 66, reach the landing phase, which brings the source's words near its target.

Sizes are numbers of words; a null text has size 0. A null source is a source of its own, last. Rows that share a doc_id stay
apart. Sources without words get target 0. An empty table gives no row. Extra columns are ignored unless asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3.0
#: Documents of a block, on average.
BLOCK = 4096
#: Documents of each power of two of words that a block reserves, and an upper bound of what it leaves fractional.
RESERVE, LEFT = 2, 2 + 2 * 32
#: Bytes of the table of sources up to which it is broadcast, after being measured; beyond, rows and sources meet in a shuffled join.
BROADCAST_BYTES = 64 << 20
_TINY = 1e-9


def size_of(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> dict[str | None, float]:
    """Words to take from each source. Sources by code point, null last; weights repeat. Together they share all sizes."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(ordered)}
    size, total = dict(ordered), float(sum(n for _, n in ordered))
    full: set = set()
    while True:
        free = [s for s, _ in ordered if s not in full]
        rest, over = total - most_times * sum(size[s] for s in full), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / over for s in free} if free else {}
        above = {s for s in free if share[s] > most_times * size[s]}
        if not above:
            return {s: float(most_times * size[s]) if s in full else share[s] for s, _ in ordered}
        full |= above


def source_table(slim: DataFrame, weights: tuple[float, ...], most_times: float, block: int) -> tuple[DataFrame, int]:
    """_source, source_size, target, blocks of every source, and the table's bytes. As `targets`, for any number of sources: ranks come from a
    sort over partitions, and each round of sharing the excess is one aggregation; one row a partition reaches the driver."""
    totals = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    rank = F.col("number") % len(weights)
    placed = numbered(totals, [F.col("source").asc_nulls_last()], "mix-sources")
    weighed = placed.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank + 1).cast("int")))
    weighed = stored(weighed.select("source", "size", "n", "weight"), "mix-weights")
    total, n_bytes = weighed.agg(F.sum("size"), F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 48)).first()
    rest, over, full = float(total or 0), 1.0, -1
    above = F.lit(False)
    while True:  # sources whose share is above their most; the set only grows
        held, free, n_full = weighed.agg(F.sum(F.when(above, F.col("size"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n_full == full:
            break
        full, rest, over = n_full, float(total or 0) - most_times * float(held or 0), float(free or 1)
        above = above | (F.lit(rest) * F.col("weight") / F.lit(over) > F.lit(most_times) * F.col("size"))
    target = F.when(above, F.lit(float(most_times)) * F.col("size")).otherwise(F.lit(rest) * F.col("weight") / F.lit(over))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long")
    return stored(weighed.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), target.alias("target"), blocks.alias("blocks")), "mix-plan"), int(n_bytes or 0)


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities moved until at most two are fractional, with their sum and that of size * p unchanged."""
    p, scaled = p.tolist(), (size / max(1.0, float(size.max(initial=0)))).tolist()
    draws = rng.random(2 * len(p) + 8).tolist()
    waiting = [k for k, x in enumerate(p) if _TINY < x < 1 - _TINY][::-1]
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 3:
            break
        a, b, c = held
        # the null vector of the rows (1, 1, 1) and (size, size, size)
        u = (scaled[c] - scaled[b], scaled[a] - scaled[c], scaled[b] - scaled[a])
        if max(map(abs, u)) < _TINY:
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else -p[k] / v for k, v in zip(held, u, strict=True) if abs(v) > _TINY * 1e-3)
        down = min(p[k] / v if v > 0 else (p[k] - 1) / v for k, v in zip(held, u, strict=True) if abs(v) > _TINY * 1e-3)
        step = up if draws.pop() * (up + down) < down else -down
        for k, v in zip(held, u, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * v))
        keep = [k for k in held if _TINY < p[k] < 1 - _TINY]
        if len(keep) == 3:  # rounding: settle the nearest
            k = min(keep, key=lambda k: min(p[k], 1 - p[k]))
            p[k] = float(round(p[k]))
            keep.remove(k)
        for k in held:
            if k not in keep:
                p[k] = float(round(p[k]))
        held = keep
        if not draws:
            draws = rng.random(1024).tolist()
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray, owed: float) -> np.ndarray:
    """Fractional documents settled, the largest first, so that what is still owed stays within reach of those that follow."""
    out = np.round(p)
    loose = sorted((k for k, x in enumerate(p) if _TINY < x < 1 - _TINY), key=lambda k: (-size[k], k))
    rest = float(sum(size[k] for k in loose))
    for k in loose:
        if not size[k]:
            out[k] = float(p[k] >= 0.5)
            continue
        rest -= size[k]
        # how far out of reach it would be, and how far from the middle of what is in reach
        cost = [(max(0.0, -x, x - rest), abs(x - rest / 2)) for x in (owed, owed - size[k])]
        out[k] = float(cost[1] < cost[0])
        owed -= out[k] * size[k]
    return out


def reserved(size: np.ndarray) -> np.ndarray:
    """The first RESERVE documents of each power of two of words: they stay for the landing, which so has sizes of every kind to choose from."""
    kind = np.where(size > 0, np.log2(np.maximum(size, 1)).astype(int), -1)
    rank = pd.Series(kind).groupby(kind).cumcount().to_numpy() if len(kind) else kind
    return (kind >= 0) & (rank < RESERVE)


def _seed(*what) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(repr(what).encode()))


def _fly(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["row", "size"], kind="stable").reset_index(drop=True)
    rng = _seed(block["source"].iloc[0], int(block["block"].iloc[0]), int(block["level"].iloc[0]))
    size, p = block["size"].to_numpy(float), block["p"].to_numpy().copy()
    free = ~reserved(size)
    p[free] = flight(p[free], size[free], rng)
    block["p"] = p
    return block


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """id_col, source_col, size, source_size, target, copies, taken (size * copies), and the columns in extra."""
    block = max(block, 2 * LEFT)
    id_kind = docs.schema[id_col].dataType.simpleString()
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    slim = docs.select(F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), row.alias("row"))
    slim = stored(slim, "mix-sizes")
    sources, n_bytes = source_table(slim, weights, most_times, block)
    if n_bytes <= BROADCAST_BYTES:
        sources = F.broadcast(sources)
    with_plan = slim.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = with_plan.withColumns({"whole": F.floor(ratio), "p": ratio - F.floor(ratio)})
    units = units.withColumns({"block": F.pmod(F.xxhash64("row", F.lit(7)), F.col("blocks")), "level": F.lit(0)})
    schema = f"doc {id_kind}, source string, size long, row long, whole long, p double, block long, level int"
    cols = [x.split()[0] for x in schema.split(", ")]
    flown = units.select(*cols).groupBy("source", "block").applyInPandas(_fly, schema)
    flown = stored(flown, "mix-flown")
    fractional = (F.col("p") > _TINY) & (F.col("p") < 1 - _TINY)
    done, left = flown.where(~fractional), flown.where(fractional)
    blocks = sources.agg(F.max("blocks")).first()[0] or 1
    level, settled = 1, []
    while blocks > 1:
        blocks = -(-blocks * LEFT // block)
        again = left.withColumns({"block": F.pmod(F.xxhash64("row", F.lit(7 + level)), F.lit(blocks)), "level": F.lit(level)})
        again = stored(again.groupBy("source", "block").applyInPandas(_fly, schema), "mix-left")
        settled.append(again.where(~fractional))
        left, level = again.where(fractional), level + 1

    sure = done
    for part in settled:
        sure = sure.unionByName(part)
    taken = sure.groupBy("source").agg(F.sum(F.col("size") * (F.col("whole") + F.round("p"))).alias("_taken"))
    base = left.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("_base"))
    owed = base.join(taken.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", (F.coalesce("_taken", F.lit(0)) + F.col("_base")).alias("_have"))
    owed = owed.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("source").alias("_s"), (F.col("target") - F.col("_have")).alias("owed"))

    def land(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "size"], kind="stable").reset_index(drop=True)
        rows["p"] = landing(rows["p"].to_numpy(), rows["size"].to_numpy(float), float(rows["owed"].iloc[0]))
        return rows[cols]

    last = left.join(owed, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").groupBy("source").applyInPandas(land, schema)
    chosen = sure.unionByName(last).withColumn("copies", (F.col("whole") + F.round("p")).cast("long"))
    out = chosen.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    out = out.select(F.col("doc").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.col("row").alias("_row"))
    if not extra:
        return out.drop("_row")
    # repeated rows are numbered alike on both sides, so each keeps its own number of copies
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("_doc", "_row").orderBy(F.lit(1)))
    fates = out.withColumnRenamed(id_col, "_doc").drop(source_col).withColumn("_n", rank)
    full = docs.select(F.col(id_col), F.col(source_col), *(F.col(x) for x in extra), F.col(id_col).alias("_doc"), row.alias("_row")).withColumn("_n", rank)
    joined = full.alias("a").join(fates.alias("b"), F.col("a._doc").eqNullSafe(F.col("b._doc")) & (F.col("a._row") == F.col("b._row")) & (F.col("a._n") == F.col("b._n")))
    return joined.select(*(F.col(f"a.{x}") for x in (id_col, source_col, *extra)), *(F.col(f"b.{x}") for x in ("size", "source_size", "target", "copies", "taken")))
