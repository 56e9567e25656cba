"""Units of code, flows of values and reports of analysers on small cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from deltaloom.operators import analysers, flows, units

BASE = 'import os\nimport re\n\nLIMIT = 3\n\n# guards\ndef check(x):\n    """Doc."""\n    return re.match("a", x)\n\nclass Box:\n    size = 1\n\n    def get(self, x):\n        if not check(x):\n            raise ValueError\n        return os.system(x)\n\nprint(LIMIT)\n'


def test_units():
    keys = [u[0][:2] for u in units.units(BASE)]
    assert keys == [("import", "import os"), ("import", "import re"), ("assign", "LIMIT"), ("def", "check"), ("class", "Box"), ("assign", "Box.size"), ("def", "Box.get"), ("stmt", "print(LIMIT)")]
    assert units.units(BASE)[3][3].startswith("# guards\n")
    assert [u[0] for u in units.units("f()\nf()\n")] == [("stmt", "f()", 0), ("stmt", "f()", 1)]


def test_slices():
    text, dropped = units.sliced(BASE, {"Box.get"})
    assert "import os" in text and "import re" not in text and "def check" not in text and "class Box" in text
    assert dropped == ["check"]
    assert units.sliced(BASE, {"check"})[0].startswith("import re\n")


def test_merges():
    changed = BASE.replace("return os.system(x)", "return x").replace('print(LIMIT)\n', "print(LIMIT)\n\ndef new():\n    pass\n")
    current = BASE.replace("LIMIT = 3", "LIMIT = 4")
    text, conflicts = units.merged(BASE, changed, current)
    assert conflicts == [] and "LIMIT = 4" in text and "return x\n" in text and "def new" in text
    assert units.merged(BASE, changed, BASE.replace("os.system(x)", "os.popen(x)"))[1] == ["def:Box.get:0"]
    assert units.merged(BASE, BASE.replace("import re\n", ""), current)[0].count("import re") == 0
    assert units.merged(BASE, BASE, current) == (current, [])


def test_scrub_tokens_diff_plan():
    text = 'def f(x):  # fixes CVE-2020-1\n    """Reads.\n\n    Prevents an attack here.\n    """\n    # plain\n    return x\n'
    out, removed = units.scrubbed(text)
    assert "CVE" not in out and "attack" not in out and "# plain" in out and "Reads." in out and len(removed) == 2
    assert units.code_tokens('def f():\n    "doc"\n    return \'a\'  # c\n') == units.code_tokens('def f():\n    return "a"\n')
    assert units.code_tokens("def (: # c") == ["def", "(", ":"]
    assert units.code_tokens('class A:\n    "doc"\n') == ["class", "A", ":", "pass"] and units.code_tokens('"doc"') == []
    assert units.code_tokens('f"{a} {b}"') != units.code_tokens('f"{a}{b}"')
    assert units.unified_diff("a.py", "x\n", "y\n") == "--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-x\n+y\n"
    turns, at, prompts = units.trace_plan("event", list("abcdefghij"))
    assert 5 <= turns <= 8 and 2 <= at <= min(6, turns) and len(set(prompts)) == turns == len(prompts)
    assert units.trace_plan("event", list("abcdefghij")) == (turns, at, prompts)
    rng = random.Random("3:event")
    n = rng.randint(5, 8)
    assert units.trace_plan("event", list("abcdefghij"), 3) == (n, rng.randint(2, min(6, n)), rng.sample(list("abcdefghij"), n))
    with pytest.raises(ValueError, match="needs 8"):
        units.trace_plan("event", list("abcdefg"))


def test_mapped(spark):
    df = spark.createDataFrame([("a.py", "x\n", None), ("b.py", None, "y\n")], "path string, old string, new string")
    rows = units.mapped(df, ["path", "old", "new"], units.unified_diff, "diff").collect()
    assert [r["diff"].splitlines()[1] for r in rows] == ["+++ /dev/null", "+++ b/b.py"]
    df = spark.createDataFrame([(1, "x = 1\n"), (2, "def (:\n"), (3, ""), (4, "(" * 150), (5, "y = " + "-" * 5000 + "1\n")], "i int, text string")
    rows = units.mapped(df, ["text"], lambda t: ",".join(u[0][1] for u in units.units(t)), "names").orderBy("i").collect()
    assert [r["names"] for r in rows] == ["x", None, "", None, "y"]


def test_origins(spark):
    depends = spark.createDataFrame([("f", "y", "x"), ("f", "z", "y"), ("f", "clean", "z"), ("f", "x", "z"), ("f", "w", "clean")], "symbol string, value string, `on` string")
    base = spark.createDataFrame([("f", "x", "param"), ("f", "clean", "sanitizer")], "symbol string, value string, origin string")
    cut = spark.createDataFrame([("f", "clean")], "symbol string, value string")
    got = {(r["value"], r["origin"]) for r in flows.origins(depends, base, cut).collect()}
    assert got == {("x", "param"), ("y", "param"), ("z", "param"), ("clean", "sanitizer"), ("w", "sanitizer")}


def test_members_and_names(spark):
    classes = spark.createDataFrame([("C", "A", 0), ("C", "B", 1), ("A", "R", 0), ("R", "C", 0)], "cls string, base string, position int")
    defs = spark.createDataFrame([("B", "m", "B.m"), ("R", "m", "R.m"), ("B", "n", "B.n")], "cls string, name string, symbol string")
    wanted = spark.createDataFrame([("C", "m"), ("C", "n"), ("C", "none"), ("B", "m")], "cls string, name string")
    assert {(r["cls"], r["name"]): r["symbol"] for r in flows.members(classes, defs, wanted).collect()} == {("C", "m"): "R.m", ("C", "n"): "B.n", ("B", "m"): "B.m"}
    assigns = spark.createDataFrame([("f", "a", "X"), ("f", "a", "X"), ("f", "b", "X"), ("f", "b", "Y"), ("f", "c", "X"), ("f", "c", None)], "symbol string, name string, cls string")
    assert [tuple(r) for r in flows.receiver_classes(assigns).collect()] == [("f", "a", "X")]
    exports = spark.createDataFrame([("p.f", "p.q.f"), ("p.q.f", "p.q.r.f"), ("loop", "loop")], "name string, target string")
    assert {r["name"]: r["target"] for r in flows.reexported(spark.createDataFrame([("p.f",), ("loop",), ("x",)], "name string"), exports).collect()} == {"p.f": "p.q.r.f", "loop": "loop", "x": "x"}
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(9)], "id string, parent string")
    assert {r["top"] for r in flows.chain_tops(chain).collect()} == {"c9"}


def test_supporting_paths(spark):
    nodes = spark.createDataFrame([("g", i, None, i == "s", i == "k", False, "") for i in ("s", "a", "b", "k", "f", "v", "w")], "graph_id string, id string, owner string, source boolean, sink boolean, sanitizer boolean, digest string")
    edges = [("s", "a", "taint", ["f"]), ("a", "k", "taint", []), ("s", "b", "taint", []), ("b", "k", "taint", []), ("f", "v", "sanitize", []), ("v", "w", "call", [])]
    edges = spark.createDataFrame([("g", *e) for e in edges], "graph_id string, src string, dst string, kind string, via array<string>")
    asked = spark.createDataFrame([("b",), ("f",), ("w",), ("none",)], "symbol string")
    got = {r["symbol"]: r["path"] for r in flows.supporting_paths(nodes, edges, asked).collect()}
    assert got == {"b": ["s", "b", "k"], "f": ["s", "a", "k"], "w": ["s", "a", "k"]}


def test_reports(spark):
    rule = {"results": [{"check_id": "r1", "path": "a.py", "start": {"line": 2}, "end": {"line": 3}, "extra": {"message": "m", "severity": "ERROR", "lines": "x  = 1", "metadata": {"cwe": ["CWE-89: SQL", "CWE-22"], "confidence": "HIGH"}}}], "paths": {"scanned": ["a.py"]}}
    code = {"results": [{"test_id": "B1", "filename": "a.py", "line_number": 5, "line_range": [5, 6], "issue_text": "t", "issue_severity": "LOW", "issue_confidence": "MEDIUM", "issue_cwe": {"id": 78}, "code": "y"}]}
    a = analysers.rule_findings(spark.createDataFrame([("k", json.dumps(rule))], "key string, json string"))
    b = analysers.code_findings(spark.createDataFrame([("k", json.dumps(code))], "key string, json string"))
    rows = analysers.identity(a.union(b)).orderBy("tool").collect()
    assert [(r["tool"], r["cwes"], r["severity"], r["start_line"], r["end_line"]) for r in rows] == [("rules", [22, 89], "high", 2, 3), ("tests", [78], "low", 5, 6)]
    assert rows[0]["identity"]["code"] == "x=1" and analysers.of_family(a.union(b), [78]).count() == 1
    files = spark.createDataFrame([("k", "a.py"), ("k", "b.py")], "key string, path string")
    assert [r["path"] for r in analysers.unscanned(files, spark.createDataFrame([("k", json.dumps(rule))], "key string, json string")).collect()] == ["b.py"]
    items = spark.createDataFrame([([],), ([("uncertain",)],), ([("not-exploitable",)],), ([(None,)],), (None,)], "items array<struct<label:string>>")
    assert [r[0] for r in items.select(analysers.decision(F.col("items"))).collect()] == ["ALLOW", "BLOCK", "ALLOW", "BLOCK", "ALLOW"]


def test_roles_edges_and_checks(spark):
    from deltaloom.operators import facts

    source = "import os\n\ndef check(v):\n    return v\n\ndef f(req):\n    a = req.get('x')\n    check(a)\n    b = os.getenv(a)\n    os.system(b)\n"
    files = spark.createDataFrame([("e", "m.py", source), ("e", "bad.py", "def"), ("g", "n.py", "x" * 30_000)], "event_id string, path string, text string")
    rows = facts.code_facts(files)
    catalog = spark.createDataFrame([("os.system", "sink", "command"), ("os.getenv", "source", "env"), ("os.system", "source", "odd")], "target string, role string, family string")
    roles = facts.call_roles(facts.resolved_calls(rows), catalog)
    assert {r["name"]: (r["role"], r["family"]) for r in roles.where("symbol = 'm.py::f'").collect()} == {"req.get": (None, None), "check": ("sanitizer", "validator"), "os.getenv": ("source", "env"), "os.system": ("sink", "command")}
    edges = {(r["kind"], r["src"], r["dst"]) for r in facts.drawn_edges(roles, rows).collect()}
    assert ("sanitize", "m.py::f", "m.py::check") in edges and ("call", "m.py::f", "os.system") in edges
    assert {e[1:] for e in edges if e[0] == "taint"} == {("unknown::req.get", "m.py::check"), ("unknown::req.get", "os.getenv"), ("os.getenv", "os.system")}
    got = {(r["event_id"], r["name"]): (r["status"], r["detail"]) for r in facts.event_checks(files, rows).collect()}
    assert got == {("e", "size"): ("ok", str(len(source) + 3)), ("e", "parse"): ("fail", "bad.py"), ("g", "size"): ("warn", "30000"), ("g", "parse"): ("ok", "")}


def test_edges_of_long_calls(spark):
    from deltaloom.operators import facts

    source = f"import os\n\ndef f(req):\n    a = req.get('x')\n    b = os.getenv('y')\n    os.system('{'select ' * 40} b', key=[a])\n"
    rows = facts.code_facts(spark.createDataFrame([("m.py", source)], "path string, text string"))
    roles = facts.call_roles(facts.resolved_calls(rows), spark.createDataFrame([("os.system", "sink", "command")], "target string, role string, family string"))
    assert [(r["src"], r["dst"]) for r in facts.drawn_edges(roles, rows).where("kind = 'taint'").collect()] == [("unknown::req.get", "os.system")]
