from __future__ import annotations

import hashlib
import json
import subprocess

import pytest

from deltaloom.sources import records
from deltaloom.sources import repositories as repos


def test_git_tree(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 'é'\n")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "c.py").write_text("")
    run("add", ".")
    run("commit", "-qm", "one")
    got = sorted((r["path"], r["text"]) for r in repos.read_git_tree(spark, str(tmp_path), "HEAD").collect())
    assert got == [("a.py", "x = 'é'\n"), ("c.py", "")]
    assert repos.file_at_commit(str(tmp_path), "HEAD", "a.py") == "x = 'é'\n" and repos.file_at_commit(str(tmp_path), "HEAD", "none.py") is None
    with pytest.raises(subprocess.CalledProcessError):
        repos.file_at_commit(str(tmp_path), "f" * 40, "a.py")


def test_files(spark, tmp_path):
    (tmp_path / "ex.json").write_text(json.dumps({"exclusions": [{"path": "t.py", "reason": "r"}, {"path": "a.py", "symbol": "f", "reason": "r"}]}))
    files, symbols = repos.read_exclusions(spark, str(tmp_path / "ex.json"))
    assert [r[0] for r in files.collect()] == ["t.py"] and [tuple(r) for r in symbols.collect()] == [("a.py", "f")]
    (tmp_path / "rules" / "x").mkdir(parents=True)
    (tmp_path / "rules" / "x" / "b.yaml").write_text("b")
    (tmp_path / "rules" / "a.yml").write_text("a")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(repos.ruleset_hash(spark, str(tmp_path / "rules")).first()) == (sha(f"a.yml\0{sha('a')}\nx/b.yaml\0{sha('b')}\n"), 2)
    (tmp_path / "j.txt").write_text('{"a": 1}\n\n{\'b\': None}\nbroken(\n')
    assert sorted(str(r["payload"]) for r in repos.read_journal(spark, str(tmp_path / "j.txt")).collect()) == ["None", '{"a": 1}', '{"b": null}']


def test_specs(spark, tmp_path):
    (tmp_path / "specs").mkdir()
    flow = {"entry": [{"symbol": "a.py::f"}], "guards": [{"symbol": "b.py::g"}], "sinks": [{"symbol": "x.py::s", "true_symbol": "a.py::s"}]}
    good = {"event_id": "e", "clean_commit": "1", "regressed_commit": "2", "vulnerability_class": "sql", "flow": flow, "regression_files": ["b.py"]}
    (tmp_path / "specs" / "good.json").write_text(json.dumps(good))
    (tmp_path / "specs" / "bad.json").write_text(json.dumps(good | {"event_id": "f", "vulnerability_class": "x", "flow": {"sinks": []}}))
    specs, problems = repos.read_specs(spark, str(tmp_path / "specs"))
    assert sorted(map(tuple, problems.collect())) == [("f", "no sink"), ("f", "unknown class")]
    assert [tuple(r) for r in repos.flow_scope(specs).collect()] == [("e", ["a.py", "b.py"], "cross_file")]
    (tmp_path / "specs" / "good.json").write_text(json.dumps(good | {"regression_files": []}))
    with pytest.raises(Exception, match="outside the regression"):
        repos.flow_scope(repos.read_specs(spark, str(tmp_path / "specs"))[0]).collect()


def test_refusals(spark, tmp_path):
    rules = tmp_path / "rules"
    rules.mkdir()
    (rules / "r.yml").write_bytes(b"a\r\nb\xff\n")
    digest = hashlib.sha256(b"r.yml\0" + hashlib.sha256(b"a\nb\xff\n").hexdigest().encode() + b"\n").hexdigest()
    pin = tmp_path / "pin.json"
    pin.write_text(json.dumps({"ruleset_sha256": digest, "rule_files": 1}))
    assert repos.pinned_rules(spark, str(rules), str(pin)) == digest
    (rules / "s.yaml").write_text("more")
    with pytest.raises(ValueError, match="2 files found, 1 expected"):
        repos.pinned_rules(spark, str(rules), str(pin))

    trace, labels = tmp_path / "t.jsonl", tmp_path / "l.json"
    trace.write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        records.load_trace(spark, str(trace))
    trace.write_text(json.dumps({"schema_version": 5, "trace_id": "t", "seed": 0, "turn": 1, "kind": "turn"}) + "\n\n")
    assert records.load_trace(spark, str(trace)).count() == 1
    body = {"event_id": "e", "scope": "local", "replications": [{"seed": 0, "turns": [{"turn": 1, "label": "clean"}]}]}
    labels.write_text(json.dumps(body | {"trace_sha256": hashlib.sha256(trace.read_bytes()).hexdigest()}))
    assert records.read_labels(spark, str(labels), str(trace)).count() == 1
    trace.write_text(trace.read_text() + "\n")
    with pytest.raises(ValueError, match="another version"):
        records.read_labels(spark, str(labels), str(trace))
    assert records.read_labels(spark, str(labels)).count() == 1
