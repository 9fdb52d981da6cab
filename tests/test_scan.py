"""Rules, statuses and diffs, held against Python's re and splitlines."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodegraph.functions import columns as C
from lodegraph.operators import cve, scan
from lodegraph.operators.rules import DETECTORS, RULES
from lodegraph.plans.driver import PROBES
from pyspark.sql import functions as F

MORE = ["", "évàl (x)", "eval\xa0(x)", "é.eval(1)", "preeval(1)", 'password = os.environ.get("PASSWORD")', "x = 1\x0beval(y)\x1cexec(z)", "except:\n  pass\n", 'token = "short"', "a\r\nb\rc d\x85e"]


def frame(spark, texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file_path string, content string")


def test_findings_are_what_python_finds(spark):
    texts = [*PROBES, *MORE, None]
    found = {(int(r["file_path"]), r["line_number"], r["rule"]) for r in scan.scan(frame(spark, texts)).collect()}
    expect = {(k, n, j) for k, t in enumerate(texts) for n, line in enumerate((t or "").splitlines(), 1) for j, r in enumerate(RULES) if re.search(r.pattern, line)}
    assert found == expect
    assert {j for *_, j in found} == set(range(len(RULES)))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*PROBES, *(w for r in RULES for w in r.needs), "=", " ", "(", ")", "'", '"', "x", "PASSWORD", "\u017fecret", ":", "True", "shell", "f", "import", "return", "\n", "except", "pass"]), max_size=6).map("".join), min_size=1, max_size=12))
def test_pieces_lose_no_finding(spark, texts):
    full = {(r["file_path"], r["line_number"], r["rule"]) for r in scan.scan(frame(spark, texts), tuple(r._replace(needs=()) for r in RULES)).collect()}
    assert {(r["file_path"], r["line_number"], r["rule"]) for r in scan.scan(frame(spark, texts)).collect()} == full


def test_splitlines_as_in_python(spark):
    rows = frame(spark, MORE).select("content", C.splitlines(F.col("content")).alias("x")).collect()
    assert [r["x"] for r in rows] == [r["content"].splitlines() for r in rows]


def test_statuses(spark):
    files = frame(spark, ["x = 1", "random.random()", "eval(x)", 'password = "hunter2"', None])
    said = {r["file_path"]: (r["status"], r["is_blocked"], r["has_warnings"]) for r in scan.report(files, scan.scan(files)).collect()}
    assert said == {"0": ("PASS", False, False), "1": ("PASS", False, False), "2": ("WARN", False, True), "3": ("BLOCK", True, True), "4": ("PASS", False, False)}


@pytest.mark.parametrize("text", ['password = "hunter2"', 'DATABASE_PASSWORD = "super_secret_123"', 'api_key = "sk-secret1234567890abcdef12345678"', 'SECRET_TOKEN = "sk-abcdefghijklmnopqrstuvwxyz"'])
def test_secrets_block(spark, text):
    rows = scan.scan(frame(spark, [text]), detectors=("secrets",)).collect()
    assert rows and all(r["severity"] == "BLOCK" and r["line_number"] > 0 and r["fix_suggestion"] for r in rows)


def test_diff_shows_only_what_is_new(spark):
    change = [("same", "eval(x)\n", "eval(x)\n"), ("moved", "eval(x)\n", "\n\n  eval(x)\n"), ("twice", "eval(x)\n", "eval(x)\neval(x)\n"), ("new", "", "eval(x)\n"), ("other", "eval(x)\n", "eval(y)\n"), ("null", None, "exec(x)"), ("gone", "eval(x)", None)]
    df = spark.createDataFrame(change, "file_path string, before string, after string")
    assert {r["file_path"] for r in scan.scan_diff(df).collect()} == {"new", "other", "null"}


def test_gate_takes_a_missing_file_as_empty(spark):
    proposals = spark.createDataFrame([("a", "eval(x)"), ("b", "eval(x)")], "file_path string, after string")
    current = spark.createDataFrame([("a", "eval(x)")], "file_path string, content string")
    assert [r["file_path"] for r in scan.check_writes(proposals, current).collect()] == ["b"]


def test_detector_order():
    assert tuple(dict.fromkeys(r.detector for r in RULES)) == DETECTORS


def test_requirements_and_status(spark):
    req = cve.requirements(spark.createDataFrame([("a>=1\n\n# x\n-e .\nb[x]\nhttps://q/z\nc ~= 2\nd",)], "text string"))
    assert sorted(r["package"] for r in req.collect()) == ["a", "b", "c", "d"]
    adv = spark.createDataFrame([("a", f"CVE-{k:02d}", "HIGH") for k in range(12)] + [("b", "CVE-9", "CRITICAL")], "package string, cve_id string, severity string")
    found = cve.check(req, adv)
    by = {r["package"]: r for r in found.collect()}
    assert len(by["a"]["cve_ids"]) == 10 and by["d"]["severity"] == "PASS"
    assert cve.status(found).first()["status"] == "BLOCK"
    assert cve.status(found.where("package = 'a'")).first()["status"] == "WARN"
    assert cve.status(found.limit(0)).first()["status"] == "PASS"
    assert {r["package"] for r in cve.vulnerable(found).collect()} == {"a", "b"}
