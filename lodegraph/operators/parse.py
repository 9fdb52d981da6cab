"""Parsing of files: a table function from (path, content) to records, spread over the cluster by file."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from ..functions import columns as C
from .parse_common import Parsed, file_id
from .parse_go import parse_go
from .parse_javascript import parse_javascript
from .parse_python import parse_python
from .resolve import as_edges

# Which language a suffix means.
LANGUAGES = {
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs"),
    "typescript": (".ts", ".tsx", ".mts"),
    "go": (".go",),
}
Parser = Callable[[str, str], Parsed]


def parse_generic(path: str, text: str) -> Parsed:
    """The file record alone."""
    return Parsed(path, None)


class Registry:
    """Parsers by suffix; unknown ones get the generic parser. It travels to the workers inside the function that uses it."""

    def __init__(self):
        self.by_suffix: dict[str, Parser] = {s: p for names, p in ((("python",), parse_python), (("javascript", "typescript"), parse_javascript), (("go",), parse_go)) for n in names for s in LANGUAGES[n]}

    def get(self, path: str) -> Parser:
        name = path.rsplit("/", 1)[-1]
        return self.by_suffix.get("." + name.rsplit(".", 1)[-1].lower() if "." in name[1:] else "", parse_generic)

    def register(self, suffix: str, parser: Parser) -> None:
        self.by_suffix[suffix.lower()] = parser

    def supported(self) -> list[str]:
        return sorted(s for s, p in self.by_suffix.items() if p is not parse_generic)


DEFAULT = Registry()
_SYMBOL = "id: string, name: string, kind: string, line_start: int, line_end: int, signature: string, docstring: string, is_async: boolean, is_public: boolean, complexity_score: double, extra: string, ordinal: int"
_EDGE = "kind: string, from_id: string, to_id: string, line_number: int"
_REF = "from_id: string, ref_name: string, kind: string, line_number: int"
SCHEMA = f"path string, language string, error string, symbols array<struct<{_SYMBOL}>>, edges array<struct<{_EDGE}>>, refs array<struct<{_REF}>>"


def _row(parse: Parser, path: str, text: str | None) -> dict:
    try:
        got = parse(path, text or "")
    except Exception as e:  # a broken file never stops the run: it is reported in its own row
        got = Parsed(path, None, error=f"{path}: {e}")
    edges = [dict(zip(("kind", "from_id", "to_id", "line_number"), x, strict=True)) for x in got.edges]
    refs = [{"from_id": a, "ref_name": n, "kind": k, "line_number": line} for a, n, k, line in got.refs]
    return {"path": path, "language": got.language, "error": got.error, "symbols": got.symbols, "edges": edges, "refs": refs}


def parse_files(files: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """One row for each file (path, content, last_modified): the file's record, and arrays of symbols, edges and references.

    A null content counts as empty. Files are parsed where they are read; nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = [_row(registry.get(p), p, t) for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                got = pa.RecordBatch.from_pylist(rows, schema)
                yield pa.RecordBatch.from_arrays([*got.columns, part.column(1), part.column(2)], [*schema.names, "content", "last_modified"])

    parsed = files.select("path", "content", F.col("last_modified").cast("double")).mapInArrow(run, SCHEMA + ", content string, last_modified double")
    text = F.coalesce("content", F.lit(""))
    return parsed.select(
        C.file_id(F.col("path")).alias("id"), "path", "language", F.octet_length(text).cast("bigint").alias("size_bytes"), C.checksum(text).alias("checksum"), "last_modified", C.line_count(text).alias("line_count"),
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("indexed_at"), "error", "symbols", "edges", "refs",
    )


def files_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("id", "path", "language", "size_bytes", "checksum", "last_modified", "line_count", "indexed_at")


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.col("id").alias("file_id"), F.explode("symbols").alias("s")).select("file_id", "path", "s.*")


def edges_of(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("path").alias("file_path"), F.explode("edges").alias("e")).select("file_path", "e.*")
    return as_edges(rows).dropDuplicates(["id"])


def refs_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file_path"), F.explode("refs").alias("r")).select("r.from_id", "r.ref_name", "r.kind", "file_path", "r.line_number")


class ParseSource:
    """The same as a SQL table function: one row for each record of one file, as JSON."""

    def eval(self, path: str, content: str) -> Iterator[tuple[str, str]]:
        row = _row(DEFAULT.get(path), path, content)
        for part in ("symbols", "edges", "refs"):
            for record in row[part]:
                yield part, json.dumps(record)


def register_udtf(spark, name: str = "parse_source") -> None:
    """Afterwards: SELECT f.path, p.* FROM f, LATERAL parse_source(f.path, f.content) p."""
    spark.udtf.register(name, UserDefinedTableFunction(ParseSource, returnType="part string, record string", name=name))


__all__ = ["DEFAULT", "LANGUAGES", "ParseSource", "Registry", "edges_of", "file_id", "files_of", "parse_files", "parse_generic", "refs_of", "register_udtf", "symbols_of"]
