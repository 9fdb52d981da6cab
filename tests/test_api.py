"""The facade and the command line."""

import json

import pytest

from lodegraph.api import Lodegraph, NotFound, records
from lodegraph.cli import main


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "a.py").write_text("from b import f\n\n\ndef top():\n    return f()\n")
    (root / "b.py").write_text("def f():\n    return g()\n\n\ndef g():\n    return eval('1')\n")
    return root, tmp_path / "w"


def test_facade(spark, tree):
    root, warehouse = tree
    g = Lodegraph(spark, str(root), f"file://{warehouse}")
    assert g.index().file_count == 2
    b = str(root / "b.py")
    assert g.stats().first()["function_count"] == 3
    assert g.data_flow(b, "g") == {"sources": ["f"], "sinks": [], "paths": [["f", "g"]], "intermediates": []}
    assert g.impact(b, "g")["direct_callers"] == ["f"]
    assert g.dependencies(str(root / "a.py"))["internal"] == ["f"]
    assert [r["name"] for r in records(g.search("TO"))] == ["top"]
    assert g.scan_file(b)["status"] == "WARN" and g.scan_secrets('password = "hunter2"')["status"] == "BLOCK" and g.scan_diff("eval(x)", "eval(x)")["status"] == "PASS"
    assert g.scan_all().count() == 1 and g.export_json().count() > 0 and g.file_map().count() == 2
    with pytest.raises(NotFound):
        g.context(b, "none")
    (root / "b.py").unlink()
    assert g.update().changes["removed"] == 1
    adv = spark.createDataFrame([("x", "CVE-1", "HIGH")], "package string, cve_id string, severity string")
    assert g.check_requirements("x==1\ny", adv)["status"] == "WARN"
    s = g.session("s")
    s.record_read("a.py", "top")
    assert s.context()["n_reads"] == 1 and s.undo() == []


def test_command_line(spark, tree, capsys):
    root, warehouse = tree
    run = lambda *a: main(["--project", str(root), "--warehouse", f"file://{warehouse}", *a], spark)
    assert run("index") == 0 and json.loads(capsys.readouterr().out)["file_count"] == 2
    assert run("impact", f"{root}/b.py::g") == 0 and json.loads(capsys.readouterr().out)["severity"] == "CRITICAL"
    assert run("context", f"{root}/b.py::none") == 1
    assert run("search", "nothing-like-this") == 0
    assert run("summary", f"{root}/b.py") == 0 and run("stats") == 0 and run("scan", "--all") == 0
    (root / "c.py").write_text('password = "hunter2"\n')
    assert run("scan", f"{root}/c.py") == 2 and run("scan", f"{root}/none.py") == 1
