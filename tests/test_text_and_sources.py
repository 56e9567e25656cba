"""Text functions, similarity, code facts, readers and writers, and the registry."""

from __future__ import annotations

import difflib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import text as tx
from deltaloom.operators import facts
from deltaloom.operators import similarity as sim
from deltaloom.sources import records


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_text_functions(spark):
    assert column(spark, ["The Apache License 2", "gnu general public license ... apache license", "Redistribution and use in source and binary forms", None, "none"], tx.licence_family) == ["Apache-2.0", "GPL", "BSD-2-Clause", None, None]
    assert column(spark, ["checkPath", "check_call", "unsafe", "is_validated", "sanitizeHTML"], tx.is_validator_name) == [True, False, False, True, True]
    assert column(spark, ["a/tests/x.py", "a/Tests/x.py", "test_a.py", "a/b_test.py", "conftest.py", "a/testing.py"], tx.is_test_path) == [True, False, True, True, True, False]
    assert column(spark, ["a/Tests/x.py", "a/x.py", "a.txt"], tx.path_class) == ["py-test", "py-source", "other"]
    assert column(spark, ["Docs/x.py", "a/_vendor/x.py", "test_x.py", "tests.py"], tx.path_class) == ["py-test", "py-test", "py-test", "py-source"]
    assert column(spark, ["a/test.py", "tests.py", "a/attest.py"], tx.is_leakage_test) == [True, True, False]
    assert column(spark, ["a.b", "a._b", "a.__init__", "_a.b"], tx.is_public_name) == [True, False, True, False]
    assert column(spark, ["MIT", "ISC", "GPL", None], tx.licence_status) == ["permissive", "confirm", "excluded", "excluded"]
    assert column(spark, ["a/{b => c}/d.py", "a/{b => }/d.py", "x.py => y.py", "z.py", "{a => b}/c.py"], tx.rename_target) == ["a/c/d.py", "a/d.py", "y.py", "z.py", "b/c.py"]
    assert [tuple(x) for x in column(spark, ["3\t1\ta/{b => c}.py", "-\t-\tx.png"], tx.changed_line)] == [("a/c.py", 3, 1, "py-source"), ("x.png", None, None, "other")]
    assert [tuple(x) for x in column(spark, ["R100\ta.py\tb.py", "M\tc.py"], tx.status_of_line)] == [("b.py", "R"), ("c.py", "M")]
    rule = "m: CWE-9\n  cwe:\n  - 'CWE-89: a'\n  - \"CWE-78: b\"\n  other: CWE-1\n"
    assert column(spark, [rule, "cwe: CWE-5", "x"], tx.declared_cwes) == [[78, 89], [5], []]
    assert column(spark, ["src/a/b.py", "a/__init__.py"], tx.module_name) == ["a.b", "a"]
    assert column(spark, ["https://github.com/Own/Re.po/pull/3/commits/abcdef1", "https://example.com/a/b/commit/abcdef1"], tx.repo_of_commit_url) == ["own/re.po", None]
    assert column(spark, [["CWE-89: x 2", "CWE-22", "none", "CWE-89"]], tx.cwe_numbers, "array<string>") == [[22, 89]]
    assert column(spark, ["a\n\n b\n"], tx.filled_lines) == [2] and column(spark, ["x" * 8], tx.approx_tokens) == [3]
    assert column(spark, ["fix a CVE-2020-1", "plain", "securely done"], tx.is_revealing) == [True, False, True]
    assert column(spark, ["a\nb\nc\nd"], lambda x: tx.lines_between(x, F.lit(2), F.lit(3))) == ["b\nc"]


def test_resemblance_and_ratio(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(12)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, x string").select("i", sim.tokens(F.col("x")).alias("w"), F.size(sim.tokens(F.col("x"))).alias("n"))
    got = {(r["i"], r["j"]): (r["shared"], r["total"]) for r in sim.nearest(df, df.withColumnRenamed("i", "j"), "i", "j", "w", k=99).collect()}
    from collections import Counter

    def grams(t):
        w = t.split()
        return Counter(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else Counter()

    want = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = grams(a), grams(b)
            if shared := sum((x & y).values()):
                want[i, j] = (shared, sum((x | y).values()))
    assert got == want
    pairs = df.select("i", F.col("w").alias("a"), "n").join(df.select(F.col("i").alias("j"), F.col("w").alias("b")).hint("broadcast"))
    rows = sim.ratios(pairs.withColumn("bound", sim.bag_bound(F.col("a"), F.col("b"))).where("n > 0"), "a", "b").collect()
    for r in rows:
        assert r["ratio"] == difflib.SequenceMatcher(None, r["a"], r["b"], autojunk=False).ratio() <= r["bound"] + 1e-12
    units = df.where("n > 0").select("i", "n", F.lit("k").alias("kind"))
    near = {(r["i_a"], r["i_b"]) for r in sim.length_bounded(units, units, "kind", least=1).collect()}
    n = {r["i"]: r["n"] for r in units.collect()}
    assert near == {(i, j) for i in n for j in n if 200 * min(n[i], n[j]) >= 80 * (n[i] + n[j])}


def test_nearest_drops_grams_that_no_candidate_has_before_it_counts(spark):
    units = spark.range(200).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(499)), lambda k: F.md5(F.concat_ws("-", "id", k))).alias("w"))
    others = units.where("i < 2").select(F.col("i").alias("j"), F.slice("w", 1, 20).alias("w"))
    found = sim.nearest(units, others, "i", "j", "w")
    assert {tuple(r) for r in found.select("i", "j", "shared", "total").collect()} == {(0, 0, 18, 498), (1, 1, 18, 498)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("count(1)") < plan.index("LeftSemi") < plan.index("Generate explode")



def test_code_facts(spark):
    source = 'import os as o\nfrom ..a import b\nfrom c import *\n\ndef f(x, *r):\n    """d"""\n    # note\n    if not x:\n        raise ValueError\n    def g():\n        return len(x)\n    return b(o.path.join(x))\n'
    rows = facts.extract("m.py", source)
    by_kind = {}
    for r in rows:
        by_kind.setdefault(r[1], []).append(r)
    assert [(r[3], r[4]) for r in by_kind["import"]] == [("o", "os"), ("b", "..a.b")] and by_kind["star-import"][0][4] == "c"
    assert [r[2] for r in by_kind["function"]] == ["m.py::f", "m.py::f.g"] and {r[3] for r in by_kind["call"]} == {"b", "o.path.join", "len"}
    digest = lambda s: next(r[7] for r in facts.extract("m.py", s) if r[1] == "function")
    assert digest(source) == digest(source.replace('"""d"""', '"""other"""').replace("# note", "")) == digest(source.replace("len(x)", "id(x)"))
    assert digest(source) != digest(source.replace("not x", "x"))
    guard = lambda s: next(r[4] for r in facts.extract("m.py", s) if r[1] == "guard")
    assert guard(source) == guard(source.replace("x", "yy")) != guard(source.replace("not x", "x"))
    df = facts.code_facts(spark.createDataFrame([("m.py", source), ("bad.py", "def"), ("none.py", None)], "path string, text string"))
    assert df.where("kind = 'error'").count() == 1
    calls = {r["name"]: (r["target"], r["resolution"]) for r in facts.resolved_calls(df).collect()}
    assert calls == {"b": ("..a.b", "import"), "o.path.join": ("os.path.join", "import"), "len": ("builtins.len", "builtin")}


def test_traces(spark, tmp_path):
    good = {"schema_version": 4, "trace_id": "t", "seed": 1, "turn": 0, "kind": "init", "files_after": {"a.py": "x"}, "changed_paths": ["a.py"], "usage": {"in": 3}, "cached": False}
    path = tmp_path / "t.jsonl"
    path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"turn": 1}) + "\n")
    rows = records.read_traces(spark, str(path))
    assert rows.count() == 2 and rows.first()["files_after"] == {"a.py": "x"}
    records.write_traces(rows, str(tmp_path / "out"))
    assert sorted(map(str, records.read_traces(spark, str(tmp_path / "out")).collect())) == sorted(map(str, rows.collect()))
    path.write_text(json.dumps(good | {"schema_version": 9}) + "\n")
    with pytest.raises(Exception, match="unknown record version"):
        records.read_traces(spark, str(path)).collect()


def test_other_sources(spark, tmp_path):
    tidy = spark.createDataFrame([("t", None, 1)], "trace_id string, event_id string, seed int")
    full = tidy.select(*[F.col(c) if c in tidy.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in records.TIDY.split(", "))])
    records.write_tidy(full, str(tmp_path / "tidy"))
    assert records.read_tidy(spark, str(tmp_path / "tidy")).collect() == full.collect()
    (tmp_path / "src" / "pkg" / ".git").mkdir(parents=True)
    (tmp_path / "src" / "pkg" / "a.py").write_bytes(b"x = 1\r\n")
    (tmp_path / "src" / "pkg" / ".git" / "b.py").write_text("y")
    assert [tuple(r) for r in records.read_sources(spark, str(tmp_path / "src")).collect()] == [("pkg/a.py", "x = 1\n")]
    (tmp_path / "prompts.txt").write_text("# pool\nfirst\n\nsecond\n")
    assert [tuple(r) for r in records.read_prompts(spark, str(tmp_path / "prompts.txt")).orderBy("number").collect()] == [(1, "first"), (2, "second")]
    (tmp_path / "twice.txt").write_text("a\na\n")
    with pytest.raises(Exception, match="repeated prompt"):
        records.read_prompts(spark, str(tmp_path / "twice.txt")).collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.json", "{}")
        z.writestr("a.json", '{"x": 1}')
    assert [(r["name"], r["ordinal"]) for r in records.read_zip_json(spark, str(tmp_path / "z.zip")).collect()] == [("a.json", 0), ("b.json", 1)]
    files = spark.createDataFrame([("s1", "a", "same"), ("s2", "a", "same"), ("s2", "b", "other")], "state_id string, path string, text string")
    records.write_blobs(files, str(tmp_path / "blobs"))
    assert sorted(map(tuple, records.read_blobs(spark, str(tmp_path / "blobs")).collect())) == sorted(map(tuple, files.collect()))
    assert spark.read.parquet(str(tmp_path / "blobs" / "blobs")).count() == 2


def test_replies():
    ok = 'Sure: {"items": [{"id": "1", "label": "uncertain"}]} done'
    assert records.parse_reply(ok, {"1"}) == {"labels": {"1": "uncertain"}}
    assert records.parse_reply(ok, {"2"})["error"] == "other ids" and records.parse_reply("nothing", set())["error"] == "no object"
    assert records.parse_reply('{"items": [{"id": 1, "label": "x"}]}', {"1"})["error"] == "unknown label"


def test_registry_and_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and entry.entry(spark).count() > 0
    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("events", "lineitem", "orders", "customer", "supplier", "part", "nation", "documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    for name in ("recall_at_introduction", "degradation_curve", "findings_introduced", "rule_r4", "trigram_resemblance_top5", "render_prompt"):
        found = con.execute(sql[name])
        columns = sorted(c[0] for c in found.description)
        at = [[c[0] for c in found.description].index(c) for c in columns]
        df = queries[name](spark, folder)
        assert sorted(df.columns) == columns
        assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in found.fetchall()), name


def test_blocks_within_a_budget(spark):
    from deltaloom.operators import states

    df = spark.createDataFrame([("a", 1, "12345"), ("a", 2, "one\ntwo\nthree"), ("a", 3, "x"), ("a", 4, "y"), ("b", 1, "abcdefghijklmnop"), ("c", 1, "short")], "k string, n int, t string")
    got = sorted((r["k"], r["n"], r["shown"], r["hidden"]) for r in states.shown_blocks(df, ["k"], "n", "t", 14).collect())
    assert got == [("a", 1, "12345", None), ("a", 2, "one\ntwo", 2), ("b", 1, "abcdefghijklmn", 0), ("c", 1, "short", None)]


def test_reports(spark):
    from deltaloom.operators import reports

    files = spark.createDataFrame([(1, "tests/a.py"), (1, "src/b.py"), (2, "src/c.py")], "event_id int, path string")
    near = spark.createDataFrame([(1, "tests/a.py", "f"), (1, "lib/x.py", "f"), (1, "lib/x.py", "f")], "event_id int, path string, symbol string")
    assert sorted(map(tuple, reports.exclusions(files, near).collect()), key=str) == [(1, "lib/x.py", "f", "near-duplicate"), (1, "tests/a.py", None, "fix-test")]
    totals = reports.leakage_totals(files, near).first().asDict()
    assert totals == {"events": 2, "fix_tests_excluded": 1, "fix_sources_left_in_scope": 2, "events_with_exclusions": 1, "exclusions": 2, "events_with_near_duplicates": 1, "near_duplicates": 2}
    assert reports.leakage_totals(files.limit(0), near.limit(0)).first()["exclusions"] == 0
