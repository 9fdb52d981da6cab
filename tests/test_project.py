"""Trees, parsing, the store, updates, sessions, watching, vectors, the facade."""

import os
import subprocess
import time

import pytest

from lodegraph.operators import lookups, queries, vector
from lodegraph.operators.parse import DEFAULT, Registry, parse_files, register_udtf, symbols_of
from lodegraph.operators.parse_common import Parsed
from lodegraph.plans import incremental
from lodegraph.plans.samples import SOURCES
from lodegraph.plans.session import Sessions
from lodegraph.sources.store import ConcurrentWrite, Store
from lodegraph.sources.tree import Config, git_changes, in_order, scan_tree
from pyspark.sql import functions as F

APP = 'from core import charge\n\n\nasync def pay(order):\n    c = charge(order)\n    return c.settle(order)\n\n\ndef main():\n    pay(1)\n'
CORE = '"""Core."""\nimport os\n\nRATE = 3\n\n\nclass Charge(Base):\n    def settle(self, order):\n        if order:\n            return check(order)\n\n\ndef check(order):\n    return os.getpid() or order\n\n\ndef charge(order):\n    return Charge(order)\n'


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "app.py").write_text(APP)
    (root / "core.py").write_text(CORE)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("function f() {}")
    (root / "notes.txt").write_text("hi")
    return root


@pytest.fixture
def indexed(spark, project, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    result = incremental.index(store, scan_tree(spark, str(project)))
    return store, project, result


def tables(store):
    return store.read("files"), store.read("symbols"), store.read("edges")


def test_scan_tree_filters(spark, project):
    (project / "bad.py").write_bytes(b"x = 1\r\ny = '\xff'\r\n")
    (project / "skip").mkdir()
    (project / "skip" / "s.py").write_text("")
    got = {os.path.basename(r["path"]): r["content"] for r in in_order(scan_tree(spark, str(project), Config(ignore_paths=("*/skip/*",)))).collect()}
    assert set(got) == {"app.py", "core.py", "bad.py"}
    assert got["bad.py"] == "x = 1\ny = '�'\n"
    assert "bad.py" not in {os.path.basename(r["path"]) for r in scan_tree(spark, str(project), strict=True).collect()}
    assert {os.path.basename(r["path"]) for r in scan_tree(spark, str(project), Config(languages=("none",))).collect()} >= {"app.py"}


def test_index_counts_and_calls(indexed):
    store, project, result = indexed
    files, symbols, edges = tables(store)
    assert result.file_count == 2 and not result.errors
    core, app = str(project / "core.py"), str(project / "app.py")
    assert {r["name"] for r in queries.callers_of(files, symbols, edges, core, "check").collect()} == {"settle"}
    assert {r["name"] for r in queries.callees_of(files, symbols, edges, core, "charge").collect()} == {"Charge"}
    assert {r["name"] for r in queries.callers_of(files, symbols, edges, core, "settle").collect()} == {"pay"}
    row = queries.impact(files, symbols, edges, core, "check").first()
    assert row["direct"] == 1 and row["severity"] == "CRITICAL" and "settle" in row["dependents"]
    ctx = queries.context(files, symbols, edges, core, "check").first()
    assert ctx["callers"] == ["settle"] and ctx["estimated_tokens"] == 300
    assert [r["path"] for r in queries.dependents(files, symbols, edges, core).collect()] == [app]
    deps = queries.dependencies(files, symbols, app).first()
    assert deps["internal"] == ["charge"] and deps["external"] == []
    flow = {(r["role"], r["name"]) for r in queries.data_flow(files, symbols, edges, core, "check").collect()}
    assert flow == {("source", "settle")}
    assert queries.impact(files, symbols, edges, core, "missing").count() == 0
    summary = {os.path.basename(r["path"]): r for r in queries.module_summary(files, symbols).collect()}
    assert summary["core.py"]["purpose"] == "Module core: defines Charge; provides settle, check, charge."


def test_index_twice_is_the_same(spark, indexed):
    store, project, _ = indexed
    before = [{tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in t.drop("indexed_at").collect()} for t in tables(store)]
    incremental.index(store, scan_tree(spark, str(project)))
    after = [{tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in t.drop("indexed_at").collect()} for t in tables(store)]
    assert str(before) and [len(x) for x in before] == [len(x) for x in after] and before == after


def test_update_equals_fresh_index(spark, indexed, tmp_path):
    store, project, _ = indexed
    (project / "core.py").write_text(CORE + "\n\ndef extra():\n    return check(2)\n")
    got = incremental.update(store, scan_tree(spark, str(project)), resolve_all=True)
    assert got.changes["modified"] == 1 and got.changes["skipped"] == 1
    fresh = Store(spark, f"file://{tmp_path}/fresh")
    incremental.index(fresh, scan_tree(spark, str(project)))
    assert {r["id"] for r in store.read("edges").collect()} == {r["id"] for r in fresh.read("edges").collect()}
    assert {r["id"] for r in store.read("symbols").collect()} == {r["id"] for r in fresh.read("symbols").collect()}
    gone = spark.createDataFrame([(str(project / "app.py"),), ("unknown.py",)], "path string")
    empty = spark.createDataFrame([], "path string, content string, last_modified double")
    assert incremental.update(store, empty, gone).changes["removed"] == 1
    assert {os.path.basename(r["path"]) for r in store.read("files").collect()} == {"core.py"}


def test_store_upserts_and_deletes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    e = [("e1", "calls", "a", "b", "f.py", 1, 1.0, False)]
    store.upsert_edges(spark.createDataFrame(e, Store.schema("edges")))
    store.upsert_edges(spark.createDataFrame([("e1", "calls", "a", "b", "g.py", 1, 2.0, True), ("e2", "calls", "a", "c", "g.py", 2, 1.0, False)], Store.schema("edges")))
    rows = {r["id"]: r for r in store.read("edges").collect()}
    assert rows["e1"]["file_path"] == "f.py" and rows["e1"]["weight"] == 2.0 and len(rows) == 2
    store.delete_edges_for_file("g.py")
    assert [r["id"] for r in store.read("edges").collect()] == ["e1"]
    assert store.read("symbols").count() == 0


def test_upsert_keeps_rows_without_an_ordinal(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/n")
    rows = [("a", "f", "one", None), ("b", "f", "old", 0), ("b", "f", "new", 1), ("b", "f", "none", None), ("c", "f", "x", -5), ("c", "f", "y", None)]
    store.upsert("symbols", spark.createDataFrame(rows, "id string, file_id string, name string, ordinal int"))
    assert {r["id"]: r["name"] for r in store.read("symbols").collect()} == {"a": "one", "b": "new", "c": "x"}


def test_two_writers_never_share_a_version(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, f"file://{tmp_path}/w") for _ in range(2))
    rows = lambda n: spark.createDataFrame([(n, n)], "path string, error string")
    assert one.write({"errors": rows("first")}) == 0
    seen = two._pointer()
    monkeypatch.setattr(two, "_pointer", lambda: seen)
    assert one.write({"errors": rows("second")}) == 1
    with pytest.raises(ConcurrentWrite):
        two.write({"errors": rows("lost")})
    assert [r["path"] for r in one.read("errors").collect()] == ["second"]
    monkeypatch.undo()
    assert two.write({"errors": rows("third")}) == 2 and one.read("errors").first()["path"] == "third"


def test_all_errors_are_stored(spark, tmp_path):
    files = spark.createDataFrame([(f"b{k:02d}.py", "def f(:\n") for k in range(9)] + [("ok.py", "x = 1\n")], "path string, content string").withColumn("last_modified", F.lit(0.0))
    store = Store(spark, f"file://{tmp_path}/e")
    got = incremental.index(store, files, shown_errors=4)
    assert got.n_errors == 9 and len(got.errors) == 4 and store.read("errors").count() == 9
    incremental.update(store, files.where("path = 'b03.py'").withColumn("content", F.lit("y = 2\n")))
    assert "b03.py" not in {r["path"] for r in store.read("errors").collect()} and store.read("errors").count() == 8


def test_sessions(spark, indexed):
    store, project, _ = indexed
    s, app = Sessions(store, str(project)), str(project / "app.py")
    s.record_read("one", app, "pay")
    blocked = s.record_write("one", app, APP, APP + 'password = "hunter2"\n')
    assert blocked["status"] == "BLOCK" and (project / "app.py").read_text() == APP
    done = s.record_write("one", app, APP, APP + "\nLIMIT = 1\n")
    assert done["status"] == "PASS" and "LIMIT" in (project / "app.py").read_text()
    assert set(done) == {"status", "file", "issues", "graph_update"} and done["file"] == app and blocked["issues"]
    ctx = s.context("one")
    assert ctx["total_events"] == 3 and ctx["summary"] == "Session 'one': 1 read(s) across 1 file(s), 2 write(s) to 1 file(s), 0 undo(s)."
    assert (ctx["n_reads"], ctx["n_writes"], ctx["files_read"]) == (1, 2, [f"{app}::pay"])
    assert s.undo("one") == [app] and (project / "app.py").read_text() == APP
    assert s.context("two")["n_reads"] == 0
    assert s.events("one").count() == 4


def test_git_changes(spark, project):
    run = lambda *a: subprocess.run(["git", "-C", str(project), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "a")
    (project / "app.py").write_text(APP + "eval(x)\n")
    run("commit", "-qam", "b")
    row = git_changes(spark, str(project), "HEAD~1..HEAD").first()
    assert row["file_path"] == "app.py" and row["before"] == APP and row["after"].endswith("eval(x)\n")


def test_broken_file_is_reported_and_others_stand(spark):
    registry = Registry()

    def bad(path, text):
        raise ValueError("no")

    registry.register(".BAD", bad)
    files = spark.createDataFrame([("a.bad", "x"), ("b.py", "def f(): pass"), ("c.py", "def f(:\n\ndef g(): pass\n"), ("d.py", None)], "path string, content string").withColumn("last_modified", F.lit(0.0))
    rows = {r["path"]: r for r in parse_files(files, registry).collect()}
    assert rows["a.bad"]["error"] == "a.bad: no" and rows["b.py"]["error"] is None
    assert rows["c.py"]["error"] and {s["name"] for s in rows["c.py"]["symbols"]} == {"g"}
    assert rows["d.py"]["symbols"] == [] and rows["d.py"]["line_count"] == 1
    assert ".py" in DEFAULT.supported()


def test_same_name_in_two_classes_is_one_symbol():
    got = DEFAULT.get("x.py")("x.py", "class A:\n    def speak(self): pass\n\nclass B(A):\n    def speak(self): pass\n")
    speak = [s for s in got.symbols if s["name"] == "speak"]
    assert len(speak) == 1 and speak[0]["line_start"] == 5
    assert sum(e[2] == speak[0]["id"] for e in got.edges) == 2


@pytest.mark.parametrize(
    ("text", "signature"),
    [
        ("def f(x=')', y=1) -> int: pass", "f(x=')', y=1) -> int"), ("async def f[T: (int, str)](a, # )(\n   b='é)'): pass", "f(a, # )(\n   b='é)')"), ("@dec('(')\ndef f(\r\n a,\r\n b): pass", "f(\r\n a,\r\n b)"),
        ("class A:\n  def f(self, *, k: dict[str, 'x)'] = {}): pass", "f(self, *, k: dict[str, 'x)'] = {})"), ("x = 'é'; y = 1\ndef f(): pass", "f()"), ("def f(x=f'{a(1)})'): pass", "f(x=f'{a(1)})')"),
    ],
)
def test_signatures_are_as_written(text, signature):
    assert next(s for s in DEFAULT.get("x.py")("x.py", text).symbols if s["name"] == "f")["signature"] == signature


def test_long_files_take_no_longer_than_their_length():
    text = "".join(f"def f{k}(x=')'):\n    'doc'\n    return g{k}(x) if x else 1\n\n" for k in range(20_000))
    begun = time.process_time()
    assert len(DEFAULT.get("x.py")("x.py", text).symbols) == 20_000 and time.process_time() - begun < 20


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_parsers_take_any_prefix(path):
    text = SOURCES[path]
    for n in range(0, len(text), 7):
        assert isinstance(DEFAULT.get(path)(path, text[:n]), Parsed)


def test_udtf(spark):
    register_udtf(spark)
    spark.createDataFrame([("a.py", "def f(): g()\n")], "path string, content string").createOrReplaceTempView("src")
    rows = spark.sql("SELECT s.path, p.part FROM src s, LATERAL parse_source(s.path, s.content) p").collect()
    assert sorted(r["part"] for r in rows) == ["edges", "refs", "symbols"]


def test_search_and_pick(indexed):
    store, project, _ = indexed
    files, symbols, _ = tables(store)
    names = lambda q, kind=None: [r["name"] for r in lookups.search_symbols(symbols, files, q, kind).collect()]
    assert "check" in names("HEC") and names("c_eck", "function") == ["check"] and names("a\\b") == []
    assert len(names("")) == symbols.count()
    assert lookups.find_symbol(files, symbols, str(project / "app.py"), "charge").first()["kind"] == "import"
    assert lookups.languages(files).first()["languages"] == ["python"]


def test_vectors(spark):
    t = spark.createDataFrame([("a", [1.0, 0.0], None), ("b", [0.0, 1.0], None), ("z", [0.0, 0.0], None)], "id string, vector array<float>, metadata map<string,string>")
    t = vector.upsert(t, spark.createDataFrame([("b", [1.0, 1.0], None)], t.schema))
    assert [r["id"] for r in vector.search(t, [1.0, 0.1]).collect()] == ["a", "b", "z"]
    assert vector.delete(t, "a").count() == 2 and vector.search(t.limit(0), [1.0]).count() == 0
    enc = vector.encode(spark.createDataFrame([("1", "Hello hello world"), ("2", None)], "id string, text string"), dim=16)
    norms = {r["id"]: sum(x * x for x in r["vector"]) for r in enc.collect()}
    assert abs(norms["1"] - 1) < 1e-5 and norms["2"] == 0


def test_nearest_of_many_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(0)
    rows = [(k, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(200)] + [(900, [0.0] * 4), (901, None), (902, [1.0, 2.0]), (903, [])]
    t = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(k, v) for k, v in rows if k % 20 == 0 or k > 900], "query long, vector array<double>")

    def distance(x, y):
        if x is None or y is None or len(x) != len(y) or not any(x) or not any(y):
            return 1.0
        x, y = np.array(x), np.array(y)
        return 1 - float(x @ y) / float(np.sqrt(x @ x) * np.sqrt(y @ y))

    got = {(r["query"], r["rank"]): round(r["distance"], 9) for r in vector.search_many(t, asked, 7).collect()}
    for q in asked.collect():
        want = sorted(round(distance(v, q["vector"]), 9) for _, v in rows)[:7]
        assert [got[q["query"], k] for k in range(1, 8)] == want


def test_encoder_that_is_given(spark):
    t = spark.createDataFrame([("1", "ab"), ("2", None)], "id string, text string")
    got = {r["id"]: r["vector"] for r in vector.encode_with(t, lambda texts: [[len(x), 1.0] for x in texts]).collect()}
    assert got == {"1": [2.0, 1.0], "2": [0.0, 1.0]}


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('[lodegraph]\nlanguages = ["go"]\n[lodegraph.security]\nignore_paths = ["*/x/*"]\nblock = true\n')
    c = Config.load(str(tmp_path / "c.toml"))
    assert c.languages == ("go",) and c.ignore_paths == ("*/x/*",) and c.other == {"block": True}
    assert Config.load("/no/such") == Config()


def test_watch(spark, indexed, tmp_path):
    from lodegraph.streaming.watch import watch

    store, project, _ = indexed
    seen = []
    query = watch(spark, store, str(project), f"file://{tmp_path}/cp", quiet_ms=200, on_update=seen.append)
    try:
        time.sleep(6)
        (project / "app.py").write_text(APP + "\n\ndef fresh():\n    pass\n")
        end = time.time() + 60
        while not seen and time.time() < end and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen and "fresh" in {r["name"] for r in store.read("symbols").collect()}
