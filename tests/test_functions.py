"""Column functions against Python's own, and what plans must show."""

import fnmatch
import hashlib
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.functions import columns as C
from lodegraph.operators import lookups, scan
from lodegraph.operators.parse_common import file_id, symbol_id
from lodegraph.operators.rules import as_table, load_rules
from pyspark.sql import functions as F

PATHS = ["a/b.py", "a/.hidden", "c.test.PY", "x/y/", "noext", "a.b/c", "d/..e.js", "Makefile.", "/abs/é.Go", ".a.b"]
TEXTS = ["", "a", "a\n", "a\nb", "\r\n\x0b", "é ü", "x" * 500 + "\n"]


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS if not p.endswith("/")], "p string").select("p", C.suffix(F.col("p")).alias("s"), C.basename(F.col("p")).alias("b")).collect()
    for r in rows:
        name = r["p"].rsplit("/", 1)[-1]
        if not name.endswith(".") and not name.startswith(".."):
            assert r["s"] == PurePosixPath(r["p"]).suffix.lower(), r
        assert r["b"] == name


def test_ids_and_counts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", C.checksum(F.col("t")).alias("c"), C.line_count(F.col("t")).alias("n"), C.file_id(F.col("t")).alias("f"), C.symbol_id(F.col("t"), F.lit("n"), F.lit("function")).alias("s")).collect()
    for r in rows:
        assert r["c"] == hashlib.sha256(r["t"].encode()).hexdigest() and r["n"] == r["t"].count("\n") + 1
        assert r["f"] == file_id(r["t"]) and r["s"] == symbol_id(r["t"], "n", "function")


def test_edge_id_of_a_null_line(spark):
    row = spark.range(1).select(C.edge_id(F.lit("a"), F.lit("b"), F.lit("calls"), F.lit(None)).alias("x"), C.edge_id(F.lit("a"), F.lit("b"), F.lit("calls"), F.lit(3)).alias("y")).first()
    assert row["x"] == hashlib.sha256(b"a:b:calls:None").hexdigest() and row["y"] == hashlib.sha256(b"a:b:calls:3").hexdigest()


GLOBS = ["*", "*.py", "*/x/*", "a?c", "[ab]*", "[!a]*", "a[", "*.(py)", "a+b*", "é*", "[a-c]?"]


@pytest.mark.parametrize("glob", GLOBS)
def test_globs(spark, glob):
    names = ["a", "abc", "a/x/b.py", "xx/x/y", "b.py", "a[", "z.(py)", "a+bc", "éa", "ca", "a\nb.py"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", F.col("n").rlike(C.glob_regex(glob)).alias("m")).collect()
    assert {r["n"]: r["m"] for r in rows} == {n: fnmatch.fnmatchcase(n, glob) for n in names}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\r\x0b\x1c\x85\xa0 a", max_size=8), min_size=1, max_size=8))
def test_strip_and_lines(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.stripped(F.col("t")).alias("s"), C.splitlines(F.col("t")).alias("l")).collect()
    assert all(r["s"] == r["t"].strip() and r["l"] == r["t"].splitlines() for r in rows)


def test_rules_from_json(spark):
    rules = load_rules('{"rules": [{"id": "X", "detector": "d", "severity": "WARN", "pattern": "foo\\\\(", "description": "calls foo", "cwe": "CWE-1"}]}')
    found = scan.scan(spark.createDataFrame([("f", "foo(1)\nbar")], "file_path string, content string"), rules).collect()
    assert [(r["line_number"], r["description"]) for r in found] == [(1, "calls foo")]
    assert as_table(spark, rules).first()["cwe"] == "CWE-1" and as_table(spark).count() > 30


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from lodegraph.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/s")
    store.write({"edges": spark.createDataFrame([("e", "calls", "a", "b", "f.py", 1, 1.0, False)], Store.schema("edges"))})
    text = plan(lookups.edges_from(store.read("edges"), "a", "calls").select("to_id"))
    assert "EqualTo(from_id,a)" in text and "EqualTo(kind,calls)" in text
    assert "ReadSchema: struct<kind:string,from_id:string,to_id:string>" in text
