"""What the walks and the dump of ``facts`` give is what Python's own ones give, and nothing is walked twice."""

from __future__ import annotations

import ast
import inspect

from deltaloom.operators import facts, linking, overlay, program

CODE = [inspect.getsource(m) for m in (facts, linking, overlay, program, ast)] + [
    "match x:\n    case None | True: pass\n    case [1, *_] | {'a': b, **c} | K(d, e=f): pass\nasync def f(a, /, b: int = 1, *c, d=2, **e) -> None:\n    async with a as b, c: await d\n    global q\n    return lambda: f'{a!r:>{b}}' + u'x' + b'y'\ntry: pass\nexcept* E as e: raise X from None\nelse: pass\nfinally: del a[1:2:3, ...]\ntype T[U: int, *V, **W] = list[U]\n",
]


def test_dump_and_walks_are_those_of_python():
    for text in CODE:
        tree = ast.parse(text)
        for statement in tree.body:
            assert facts.dumped(statement) == ast.dump(statement)
        for node in ast.walk(tree):
            plain = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)
            assert facts.children(node) == [c for c in ast.iter_child_nodes(node) if not isinstance(c, plain)]


def test_texts_of_calls_are_those_of_python():
    for text in CODE:
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.Call):
                assert facts.shown(node) == ast.unparse(node)


def test_files_are_parsed_once_for_their_calls(spark, tmp_path):
    rows = spark.createDataFrame([("a.py", "import os as o\ndef f(): return o.x(len(f()))\n")], "path string, text string")
    log = str(tmp_path / "parsed")

    def noted(batches):
        for batch in batches:
            with open(log, "a") as out:
                out.write("x" * batch.num_rows)
            yield batch

    found = facts.resolved_calls(facts.code_facts(rows.mapInArrow(noted, rows.schema)))
    assert {(r["name"], r["target"], r["resolution"]) for r in found.collect()} == {("o.x", "os.x", "import"), ("len", "builtins.len", "builtin"), ("f", "a.py::f", "same-module")}
    assert open(log).read() == "x"


def test_a_definition_is_walked_once(monkeypatch):
    seen = []
    plain = facts.own_nodes
    monkeypatch.setattr(facts, "own_nodes", lambda node: seen.append(node) or plain(node))
    rows = facts.extract("a.py", "def f(a):\n    if a:\n        def g(): return h(a)\n        raise E(a)\n    return g\n")
    assert len(seen) == 3 and [r[2] for r in rows if r[1] == "function"] == ["a.py::f", "a.py::f.g"]
