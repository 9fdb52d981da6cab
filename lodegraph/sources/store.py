"""The stored tables: Parquet in versions, the current one named by a pointer that is written last."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KEYS, TABLES


#: Pointers of old versions that stay for readers.
KEPT = 50


class ConcurrentWrite(RuntimeError):
    """Another writer made the version that this one was to make."""


def store_path(root: str, project: str) -> str:
    return f"{root.rstrip('/')}/{hashlib.sha256(os.path.realpath(project).encode()).hexdigest()[:16]}"


class Store:
    """Tables below a path. A version holds new snapshots; tables that a write doesn't name stay in the version that has them.

    A reader of an old version isn't disturbed, and a run that ends half-way leaves no trace but unused files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def schema(table: str) -> T.StructType:
        return TABLES[table]

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointer(self) -> tuple[int, dict[str, str]]:
        """The newest version, -1 if there is none, and the folder of each table."""
        fs, p = self._fs(f"{self.path}/current")
        names = sorted((str(x.getPath().getName()) for x in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
        for name in names:
            stream = fs.open(self._fs(f"{self.path}/current/{name}")[1])
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("}"):  # else its writer hasn't finished: the one before holds
                return int(name), json.loads(text)
        return -1, {}

    def _commit(self, version: int, tables: dict[str, str]) -> None:
        """The pointer of a version is made by one writer only: creation fails where it exists. Pointers long out of date are removed."""
        fs, p = self._fs(f"{self.path}/current/{version:012d}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                raise ConcurrentWrite(f"version {version} was written by another; read again and repeat") from e
            raise
        out.write(json.dumps(tables, sort_keys=True).encode())
        out.close()
        old, p = self._fs(f"{self.path}/current/{version - KEPT:012d}")
        if version >= KEPT and old.exists(p):
            old.delete(p, False)

    def _try(self, path: str, schema) -> DataFrame | None:
        fs, p = self._fs(path)
        return self.spark.read.schema(schema).parquet(path) if fs.exists(p) else None

    def read(self, table: str) -> DataFrame:
        """The current snapshot, or an empty table. Columns that the schema doesn't name are left out."""
        if table == "events":
            got = self._try(f"{self.path}/events", TABLES[table])
        else:
            at = self._pointer()[1].get(table)
            got = self._try(f"{self.path}/{at}/{table}", TABLES[table]) if at is not None else None
        return got if got is not None else self.spark.createDataFrame([], TABLES[table])

    def write(self, tables: dict[str, DataFrame]) -> int:
        """New snapshots of some tables, visible together. Fails with ConcurrentWrite, leaving no trace but unused files, if another writer was first."""
        version, now = self._pointer()
        at = f"v{version + 1}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            columns = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]
            df.select(*columns).write.parquet(f"{self.path}/{at}/{name}")
        self._commit(version + 1, now | dict.fromkeys(tables, at))
        return version + 1

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{table}")

    def upsert(self, table: str, rows: DataFrame, keep_first: tuple[str, ...] = ()) -> None:
        """Rows by key; of repeated keys in the batch the last by ordinal (if there is one; null is before all) wins. keep_first: columns that an existing row keeps."""
        key, old = KEYS[table], self.read(table)
        rows = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[table].fields))
        new = rows.dropDuplicates([key])
        if "ordinal" in rows.columns:
            new = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.coalesce(F.col("ordinal").cast("long"), F.lit(-(2**40)))).alias("_row")).select("_row.*")
        if keep_first:
            had = old.select(key, *(F.col(c).alias(f"_{c}") for c in keep_first))
            new = new.join(had, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in keep_first else F.col(c) for c in new.columns))
        self.write({table: old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))})

    def upsert_edges(self, rows: DataFrame) -> None:
        """An existing edge keeps all but its weight and whether it is conditional."""
        self.upsert("edges", rows, keep_first=("kind", "from_id", "to_id", "file_path", "line_number"))

    def delete(self, table: str, column: str, value: str) -> None:
        self.write({table: self.read(table).where(~F.col(column).eqNullSafe(F.lit(value)))})

    def delete_file(self, id_: str) -> None:
        self.delete("files", "id", id_)

    def delete_symbols_for_file(self, file_id: str) -> None:
        self.delete("symbols", "file_id", file_id)

    def delete_edges_for_file(self, path: str) -> None:
        self.delete("edges", "file_path", path)
