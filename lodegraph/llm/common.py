"""Shared helpers: the shared working folder, written intermediate tables, file access from executors."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where local runs, as of tests, keep intermediate tables if no shared folder is named.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/lodegraph"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: A side may be broadcast up to this many rows of two long columns (about 32 MB), after being counted.
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure that a shared folder is named."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local one if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL_CHECKPOINTS
        os.makedirs(found, exist_ok=True)
        found = f"file://{found}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and outlives a lost executor."""
    spark = df.sparkSession
    at = fresh_dir(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables. Only for those whose readers have all been written: a lost executor can't ask for them again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of plans that nothing refers to any more: Spark does so once the driver has collected its garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only if df is known to have at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df, stored, with a column `number`: each row's place from 0 in the order. A sort over partitions; one row a partition reaches the driver."""
    at = {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    placed = stored(df.orderBy(*order).withColumns(at), name)
    begun, begins = 0, []
    for part, n in sorted(tuple(x) for x in placed.groupBy("_part").count().collect()):
        begins.append((part, begun))
        begun += n
    starts = F.broadcast(df.sparkSession.createDataFrame(begins, "_part int, _begun long"))
    return placed.join(starts, "_part").withColumn("number", F.col("_begun") + F.col("_at")).drop("_part", "_at", "_begun")


def crc_bucket(col: Column) -> Column:
    """crc32(id as text) mod 5."""
    return F.crc32(col.cast("string").cast("binary")) % 5


_MEMOS: dict[str, Callable[[], None]] = {}


def only_memo(name: str, clear: Callable[[], None]) -> None:
    """A worker serves one operator after another: the memos of the others are cleared when one begins."""
    if name not in _MEMOS:
        for other in list(_MEMOS):
            _MEMOS.pop(other)()
        _MEMOS[name] = clear
        release()


def release() -> None:
    """Hand freed memory back to the system: Arrow's and the allocator's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: the memory stays with the process
        return


def parts(batches: Iterator, most: int) -> Iterator:
    """Arrow batches of at most so many rows. Each is a copy: text functions of Arrow misread arrays that share another's bytes from an offset."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.take(pa.array(np.arange(at, min(at + most, batch.num_rows))))
    release()


def words_of(text: str | None) -> list[str]:
    """Runs of characters other than space and tab to carriage return."""
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


class Files:
    """Files below a URI, from the driver or an executor; file: needs a folder that all of them share."""

    def __init__(self, uri: str):
        self.local = uri.startswith(("file:", "/"))
        if self.local:
            self.root = re.sub(r"^file:/*", "/", uri)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def make(self) -> None:
        if self.local:
            os.makedirs(self.root, exist_ok=True)
        else:
            self.fs.create_dir(self.root, recursive=True)

    def write(self, name: str, chunks: Iterable[bytes]) -> None:
        """Under another name first: a lost or doubled task never leaves half a file."""
        part = f"{self.path(name)}.{uuid.uuid4().hex}.part"
        with open(part, "wb") if self.local else self.fs.open_output_stream(part) as f:
            for chunk in chunks:
                f.write(chunk)
        if self.local:
            os.replace(part, self.path(name))
        else:
            self.fs.move(part, self.path(name))

    def open(self, name: str):
        return open(self.path(name), "rb") if self.local else self.fs.open_input_file(self.path(name))
