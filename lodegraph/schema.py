"""Fixed schemas of the stored tables. They are always passed to readers, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds that records may have.
NODE_KINDS = ("file", "function", "class", "variable", "type", "import", "module")
EDGE_KINDS = ("calls", "imports", "inherits", "uses", "data_flows", "defines", "exports", "tests", "references")
SEVERITIES = ("INFO", "WARN", "BLOCK")
EVENT_KINDS = ("READ", "WRITE", "UNDO")



def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in columns])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()  # noqa: E741

FILES = _struct(("id", S), ("path", S), ("language", S), ("size_bytes", L), ("checksum", S), ("last_modified", D), ("line_count", I), ("indexed_at", D))
SYMBOLS = _struct(("id", S), ("file_id", S), ("name", S), ("kind", S), ("line_start", I), ("line_end", I), ("signature", S), ("docstring", S), ("is_async", B), ("is_public", B), ("complexity_score", D), ("extra", S), ("ordinal", I))
EDGES = _struct(("id", S), ("kind", S), ("from_id", S), ("to_id", S), ("file_path", S), ("line_number", I), ("weight", D), ("is_conditional", B))
REFS = _struct(("from_id", S), ("ref_name", S), ("kind", S), ("file_path", S), ("line_number", I))
ISSUES = _struct(("id", S), ("file_id", S), ("symbol_id", S), ("detector", S), ("severity", S), ("category", S), ("line_number", I), ("description", S), ("fix_suggestion", S), ("detected_at", D), ("resolved", B))
EVENTS = _struct(("id", S), ("session_id", S), ("event_type", S), ("file_path", S), ("symbol_name", S), ("content_before", S), ("content_after", S), ("security_report", S), ("created_at", D), ("seq", L))
VECTORS = _struct(("id", S), ("vector", T.ArrayType(T.FloatType())), ("metadata", T.MapType(S, S)))
FINDINGS = _struct(("file_path", S), ("line_number", I), ("severity", S), ("category", S), ("description", S), ("fix_suggestion", S), ("detector", S), ("rule", I))
ERRORS = _struct(("path", S), ("error", S))
TABLES = {"errors": ERRORS, "files": FILES, "symbols": SYMBOLS, "edges": EDGES, "refs": REFS, "issues": ISSUES, "events": EVENTS, "vectors": VECTORS}
KEYS = {"files": "id", "symbols": "id", "edges": "id", "issues": "id", "events": "id", "vectors": "id"}
