"""Vectors by id: upsert, delete, count, exact nearest neighbours by cosine distance, and a hashing encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import add

#: Queries that meet all rows at once.
QUERY_BLOCK = 1000


def upsert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return add(table, rows)


def delete(table: DataFrame, id_: str) -> DataFrame:
    return table.where(F.col("id") != id_)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(table: DataFrame, vector: list[float], top_k: int = 10, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """id, distance of the nearest, ascending, ties by id. Null and zero vectors are at distance 1."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    v = F.col(vector_col)
    norm = F.sqrt(_dot(v, v)) * float(sum(x * x for x in vector) ** 0.5)
    return table.select(F.col(id_col), F.when(norm > 0, 1 - _dot(v, q) / norm).otherwise(1.0).alias("distance")).orderBy("distance", id_col).limit(top_k)


def search_many(table: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """query, id, distance, rank for a stated set of queries (query, vector), in blocks of about QUERY_BLOCK that meet all rows one at a time.

    A block's distances are one matrix product for each batch of rows, and only a batch's nearest of each query travel on. Null and zero
    vectors, and those of other lengths than the query's, are at distance 1.
    """
    marked = queries.select("query", F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-marked.count() // QUERY_BLOCK))
    out = None
    for k in range(blocks):
        block = (marked if blocks == 1 else marked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)).collect()
        found = _nearest(table, [r["query"] for r in block], [r["vector"] for r in block], queries.schema["query"].dataType.simpleString(), top_k)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k)


def _nearest(table: DataFrame, names: list, vectors: list, name_kind: str, top_k: int) -> DataFrame:
    """query, id, distance of the nearest in each batch of rows. The block of queries is sent once to each executor."""
    id_kind = table.schema["id"].dataType.simpleString()
    by_length: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        by_length.setdefault(len(v or ()), []).append(k)
    sent = table.sparkSession.sparkContext.broadcast((names, {n: (at, np.array([vectors[k] or [] for k in at], float)) for n, at in by_length.items()}))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sides = sent.value
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            asked, near, far = [], [], []
            for n, (at, q) in sides.items():
                distance = np.ones((len(at), batch.num_rows))
                rows = np.flatnonzero(sizes == n)
                if n and len(rows):
                    v = np.array(vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), n)
                    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
                    distance[:, rows] = np.where(norm > 0, 1 - (q @ v.T) / np.where(norm > 0, norm, 1), 1.0)
                for j, k in enumerate(at):
                    d = distance[j]
                    some = np.flatnonzero(d <= np.partition(d, top_k - 1)[top_k - 1]) if len(d) > top_k else np.arange(len(d))
                    if len(some) > top_k:  # ties go by id
                        some = np.array(sorted(some.tolist(), key=lambda r: (d[r], ids[r].as_py()))[:top_k])
                    asked += [names[k]] * len(some)
                    near += some.tolist()
                    far += d[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(asked, kinds[0]), ids.take(pa.array(near, pa.int64())), pa.array(far, pa.float64())], ["query", "id", "distance"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(T._parse_datatype_string(name_kind))]
    return table.select("id", F.col("vector").cast("array<double>")).mapInArrow(search, f"query {name_kind}, id {id_kind}, distance double")


def encode_with(texts: DataFrame, model: Callable[[list[str]], np.ndarray], id_col: str = "id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """id, vector by a model that is given: a function from texts to one row of numbers each, called with at most `rows` texts. Null counts as empty."""
    id_kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                made = np.asarray(model([t or "" for t in part.column(1).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(made), pa.list_(pa.float32()))], [id_col, "vector"])

    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_kind}, vector array<float>")


def encode(texts: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = 256) -> DataFrame:
    """id, vector: hashed word counts, L2-normalised. A stand-in where no sentence model is at hand; not the same vectors."""
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\W+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    counts = texts.select(F.col(id_col), F.explode_outer(slots).alias("slot")).groupBy(id_col, "slot").agg(F.count("slot").alias("n"))
    by = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "n")))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    value = lambda k: F.when(F.col("norm") > 0, F.coalesce(F.element_at("m", k), F.lit(0)) / F.col("norm")).otherwise(0.0).cast("float")
    return by.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("vector"))
