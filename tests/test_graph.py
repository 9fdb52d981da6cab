"""Traversals on small graphs made by hand, and properties on random ones."""

import random

import pytest

from lodegraph.operators import graph
from lodegraph.operators.queries import severity
from pyspark.sql import functions as F

CHAIN = [("a", "b"), ("b", "c"), ("c", "d")]
CYCLE = [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4"), ("5", "4")]


def edges(spark, pairs, kind="calls"):
    rows = [(f"e{k}", kind, a, b, "f.py", 5, 1.0) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id string, kind string, from_id string, to_id string, file_path string, line_number int, weight double")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def got(df, column="id"):
    return {r[column] for r in df.collect()}


def test_callers_and_callees_need_symbols_and_the_kind(spark):
    e = edges(spark, [("main", "pay"), ("main", "check"), ("main", "pay"), ("ghost", "pay")]).unionByName(edges(spark, [("child", "pay")], "inherits"))
    s = ids(spark, "main", "pay", "check", "child")
    assert got(graph.callers(e, s).where("id = 'pay'"), "caller") == {"main"}
    assert got(graph.callees(e, s).where("id = 'main'"), "callee") == {"pay", "check"}


def test_neighbors_grow_with_depth(spark):
    e = edges(spark, CHAIN)
    assert got(graph.neighbors(e, ids(spark, "a"), 1)) == {"b"}
    assert got(graph.neighbors(e, ids(spark, "a"), 2)) == {"b", "c"}
    assert got(graph.neighbors(e, ids(spark, "missing"), 2)) == set()


def test_closures_on_a_cycle_leave_out_the_start(spark):
    e = edges(spark, CYCLE)
    assert got(graph.reach(e, ids(spark, "4"))) == {"1", "2", "3", "5"}
    assert got(graph.reach(e, ids(spark, "1"))) == {"2", "3"}
    assert got(graph.reach(e, ids(spark, "1"), "dependencies")) == {"2", "3", "4"}


def test_simple_paths(spark):
    e = edges(spark, CYCLE + [("1", "2")])
    assert [r["path"] for r in graph.simple_paths(e, "1", "4").collect()] == [["1", "2", "3", "4"]]
    assert len(graph.simple_paths(e, "1", "4", parallel=True).collect()) == 2
    assert graph.simple_paths(e, "1", "4", cutoff=2).collect() == []
    assert graph.simple_paths(e, "1", "1").collect() == []


def test_subgraph(spark):
    e = edges(spark, CHAIN)
    assert {(r["from_id"], r["to_id"]) for r in graph.subgraph(e, ids(spark, "a"), 2).collect()} == {("a", "b"), ("b", "c")}


def test_self_loop_exports_once(spark):
    e = edges(spark, [("x", "x")])
    n = spark.createDataFrame([("x", "function", 'na"me')], "id string, kind string, name string")
    assert sorted(r["line"] for r in graph.dot_rows(n, e).collect()) == ['  "x" -> "x" [label="calls"];', '  "x" [label="na\\"me" tooltip="function"];']
    assert {r["part"] for r in graph.json_rows(n, e).collect()} == {"nodes", "edges"}


def test_remove_nodes_takes_their_edges(spark):
    n, e = graph.remove_nodes(ids(spark, "a", "b", "c", "d"), edges(spark, CHAIN), ids(spark, "b", "none"))
    assert got(n) == {"a", "c", "d"}
    assert got(e, "from_id") == {"c"}


def test_write_dot(spark, tmp_path):
    graph.write_dot(ids(spark, "a").withColumn("kind", F.lit("x")), edges(spark, CHAIN), f"file://{tmp_path}/g")
    assert any("node [shape=box]" in p.read_text() for p in (tmp_path / "g").glob("part-*")) and any("rankdir" in p.read_text() for p in (tmp_path / "g").glob("part-*"))


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_is_what_walking_finds(spark, seed):
    rng = random.Random(seed)
    pairs = [(str(rng.randint(0, 12)), str(rng.randint(0, 12))) for _ in range(18)]
    found = {(r["source"], r["id"]) for r in graph.reach(edges(spark, pairs), ids(spark, *(str(k) for k in range(13))), "dependencies").collect()}
    expect = set()
    for s in map(str, range(13)):
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        expect |= {(s, x) for x in seen - {s}}
    assert found == expect


def test_a_chain_of_any_length_closes(spark):
    e = spark.range(10_049).select(F.col("id").cast("string").alias("from_id"), (F.col("id") + 1).cast("string").alias("to_id"))
    row = graph.reach(e, ids(spark, "0"), "dependencies").agg(F.count(F.lit(1)).alias("n"), F.max("hops").alias("far"), F.sum("hops").alias("all")).first()
    assert (row["n"], row["far"], row["all"]) == (10_049, 10_049, sum(range(10_050)))


@pytest.mark.parametrize("seed", [1, 2])
def test_deep_graphs_and_cycles(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "DEEP", 3)
    rng = random.Random(seed)
    pairs = {(k, k + 1) for k in range(60)} | {(rng.randrange(60), rng.randrange(60)) for _ in range(4)}
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)

    def far(start):
        seen, todo = {start: 0}, [start]
        for x in todo:
            for y in ahead.get(x, ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen

    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "from_id string, to_id string")
    seeds = spark.createDataFrame([("s", "0"), ("s", "30"), ("7", "7")], "source string, id string")
    found = {(r["source"], r["id"]): r["hops"] for r in graph.reach(e, seeds, "dependencies").collect()}
    both = {k: min(far(0).get(k, 99), far(30).get(k, 99)) for k in far(0).keys() | far(30).keys()}
    assert found == {("s", str(k)): n for k, n in both.items() if n} | {("7", str(k)): n for k, n in far(7).items() if n}
    cyclic = {str(k) for k in ahead if any(y != k and k in far(y) for y in ahead[k])}
    assert {r["id"] for r in graph.on_cycles(e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))).collect()} == cyclic


def test_files_export_by_their_last_name(spark):
    n = spark.createDataFrame([("f1", "file", "a/b/c.py")], "id string, kind string, path string")
    none = edges(spark, [("f1", "f1")])
    assert any('"name":"c.py"' in r["json"] for r in graph.json_rows(n, none).collect())
    assert any('[label="c.py" tooltip="file"]' in r["line"] for r in graph.dot_rows(n, none).collect())


def test_severity_bounds(spark):
    rows = spark.createDataFrame([(n, p) for n in (0, 3, 4, 10, 11, 20, 21) for p in (False, True)], "n int, p boolean")
    said = {(r["n"], r["p"]): r["s"] for r in rows.withColumn("s", severity(F.col("n"), F.col("p"))).collect()}
    assert [said[n, False] for n in (0, 3, 4, 10, 11, 20, 21)] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    assert said[0, True] == "CRITICAL"
