"""Graph operators and the delta rules on hand-built graphs, and closures against a plain search."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from deltaloom.operators import delta, findings, graph, states

NODES = "graph_id string, id string, owner string, source boolean, sink boolean, sanitizer boolean, digest string"
EDGES = "graph_id string, src string, dst string, kind string, via array<string>"


def build(spark, edges, sources=("s",), sinks=("k",), sanitizers=("q",), more=(), digests=None):
    ids = sorted({x for e in edges for x in e[:2]} | set(more))
    nodes = [("g", i, None, i in sources, i in sinks, i in sanitizers, (digests or {}).get(i, "")) for i in ids]
    rows = [("g", a, b, kind, list(via)) for a, b, kind, via in edges]
    return delta.Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES))


def t(a, b, *via):
    return a, b, "taint", via


def flags(before, after, hops=None, rules=tuple(delta.RULES)):
    return sorted((r["rule"], r["a"], r["b"], tuple(r["detail"])) for r in delta.apply_rules(before, after, hops, rules).collect())


def test_new_path_and_control(spark):
    guarded = build(spark, [t("s", "q", "f"), t("q", "k", "f"), ("f", "q", "sanitize", ())], more=("f",))
    bare = build(spark, [t("s", "k", "f"), ("f", "q", "sanitize", ())], more=("f",))
    assert flags(guarded, bare, rules=["R2"]) == [("R2", "s", "k", ("s", "k"))]
    assert flags(bare, guarded, rules=["R2"]) == []
    assert flags(guarded, guarded) == []


def test_sanitizer_gone_and_bypassed(spark):
    before = build(spark, [t("s", "q", "f"), t("q", "k", "f"), ("f", "q", "sanitize", ()), ("h", "q", "sanitize", ())], more=("f", "h"))
    gone = build(spark, [t("s", "k", "f")], more=("f", "h"))
    around = build(spark, [t("s", "q", "f"), t("q", "k", "f"), t("s", "k", "f"), ("f", "q", "sanitize", ()), ("h", "q", "sanitize", ())], more=("f", "h"))
    assert flags(before, gone, rules=["R1"]) == [("R1", "q", None, ("f", "h"))]
    assert flags(before, around, rules=["R1"]) == [("R1", "q", "f", ("k",))]
    assert flags(before, build(spark, [t("s", "k", "x")]), rules=["R1"]) == []  # nobody is left


def test_guard_removed(spark):
    base = [t("s", "f", "f"), t("f", "k", "f")]
    before = build(spark, [*base, ("f", "q", "sanitize", ()), ("z", "q", "sanitize", ())])
    after = build(spark, [*base, ("f", "p", "sanitize", ()), ("z", "q", "sanitize", ())], sanitizers=("q", "p"))
    assert flags(before, after, rules=["R3"]) == [("R3", "f", "q", ("p",))]
    assert flags(before, build(spark, [*base, ("f", "q", "sanitize", ())]), rules=["R3"]) == []  # z isn't on a path


def test_shorter_path_and_ties(spark):
    long = build(spark, [t("s", "b"), t("s", "a"), t("a", "k"), t("b", "k"), t("k", "s")])
    short = build(spark, [t("s", "a"), t("a", "k"), t("s", "k")])
    assert [(r["path"], r["hops"]) for r in long.paths.collect()] == [(["s", "a", "k"], 2)]
    assert flags(long, short, rules=["R4"]) == [("R4", "s", "k", ("2", "1"))]
    assert flags(short, long, rules=["R4"]) == []


def test_bound(spark):
    chain = [t(f"n{i}", f"n{i + 1}") for i in range(6)]
    before = build(spark, [t("s", "n0"), *chain], sinks=("n6",), digests={"n0": "old"})
    after = build(spark, [t("s", "n0"), *chain, t("s", "n6")], sinks=("n6",), digests={"n0": "new"})
    same = build(spark, [t("s", "n0"), *chain, t("s", "n6")], sinks=("n6",), digests={"n0": "old"})
    assert flags(before, after, None, ["R4"]) == [("R4", "s", "n6", ("7", "1"))]
    assert flags(before, after, 2, ["R4"]) == [] and flags(before, same, 2) == []


@pytest.mark.parametrize("seed", range(2))
def test_closures_are_searches(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"v{rng.randrange(25):02}", f"v{rng.randrange(25):02}") for _ in range(40)})
    g = build(spark, [t(a, b) for a, b in pairs], sources=("v00", "v01"), sinks=("v07", "v08", "v09"), sanitizers=("v03",))
    out = {}
    for a, b in pairs:
        if "v03" not in (a, b):
            out.setdefault(a, []).append(b)
    want = {}
    for source in ("v00", "v01"):
        level, seen = [(source,)], {source: (source,)}
        while level:
            new = {}
            for p in level:
                for b in out.get(p[-1], ()):
                    if b not in seen:
                        new[b] = min(new.get(b, (*p, b)), (*p, b))
            seen |= new
            level = list(new.values())
        want |= {(source, k): p for k, p in seen.items() if k in ("v07", "v08", "v09")}
    assert {(r["source"], r["sink"]): tuple(r["path"]) for r in g.paths.collect()} == want


def test_merge_overlay_and_removal(spark):
    edges = spark.createDataFrame([("g", "a", "b", "taint", ["y", "x"], "late", 2), ("g", "a", "b", "taint", ["x"], "early", 1)], EDGES + ", resolution string, ord int")
    assert [(r["via"], r["resolution"]) for r in graph.merged_edges(edges, "ord").collect()] == [(["x", "y"], "early")]
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    change = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(tuple(r) for r in graph.overlaid(base, change, ["k"]).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    symbols = spark.createDataFrame([("A",), ("A.f",), ("A.f.g",), ("AB",)], "qualname string")
    assert sorted(r[0] for r in graph.without_symbols(symbols, symbols.where("qualname = 'A.f'")).collect()) == ["A", "AB"]


def test_findings_are_multisets(spark):
    schema = "rule string, file string, line int"
    before = spark.createDataFrame([("r", "f", 1), ("r", "f", 9)], schema)
    after = spark.createDataFrame([("r", "f", 4), ("r", "f", 5), ("r", "f", 6), ("r", "g", 1), (None, "f", 2)], schema)
    got = sorted(map(tuple, findings.introduced(after, before, ["rule", "file"], ["line"]).collect()), key=str)
    assert got == sorted([("r", "f", 6), ("r", "g", 1), (None, "f", 2)], key=str)
    assert findings.introduced(before, after, ["rule", "file"], ["line"]).count() == 0
    top = findings.top_groups(after, ["file"], "line", groups=1, members=2).first()
    assert top["members"] == [2, 4] and top["more"] == 2


def test_states(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "path string, text string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", None)], "path string, text string")
    assert sorted((r["path"], r["change"]) for r in states.changes(a, b, ["path"], "text").collect()) == [("w", "added"), ("y", "modified"), ("z", "removed")]
    assert sorted(r["path"] for r in states.applied(a, b, ["path"]).collect()) == ["w", "x", "y", "z"]
    store = spark.createDataFrame([("k", 1, "old"), ("l", 1, "old")], "key string, at int, v string")
    new = spark.createDataFrame([("k", 0, "new"), ("k", 2, "newest")], "key string, at int, v string")
    assert sorted((r["key"], r["v"]) for r in states.upserted(store, new, ["key"], "at").collect()) == [("k", "newest"), ("l", "old")]
    assert states.first_of(spark.createDataFrame([(None, 1), (None, 2), ("c", 4), ("c", 3)], "cve string, n int"), "cve", "n").agg(F.sum("n")).first()[0] == 6
    hit, miss = states.hits_and_misses(a, b.select("path", F.lit(1).alias("v")), ["path"])
    assert hit.count() == 2 and [r["path"] for r in miss.collect()] == ["z"]


def test_shortest_free_paths_of_more_sinks_than_a_block_has(spark):
    """Against a search from each source; 150 sinks are three blocks of 64, and a chain is longer than the others' ways."""
    rng = random.Random(3)
    names = [f"n{i:03d}" for i in range(200)]
    links = {(rng.choice(names), rng.choice(names)) for _ in range(500)} | {(f"z{i:02d}", f"z{i + 1:02d}") for i in range(19)}
    names += [f"z{i:02d}" for i in range(20)]
    role = {x: (i % 9 == 0 or x == "z00", i % 4 != 0 or x == "z19", i % 25 == 3) for i, x in enumerate(names)}
    nodes = spark.createDataFrame([("g", x, None, *role[x], "") for x in names], "graph_id string, id string, owner string, source boolean, sink boolean, sanitizer boolean, digest string")
    edges = spark.createDataFrame([("g", a, b, "taint", []) for a, b in links], "graph_id string, src string, dst string, kind string, via array<string>")
    after = {}
    for a, b in links:
        if not role[a][2] and not role[b][2]:
            after.setdefault(a, []).append(b)
    want = set()
    for x in names:
        if role[x][0] and not role[x][2]:
            best, layer = {x: (x,)}, [x]
            while layer:
                found = {}
                for a in layer:
                    for b in after.get(a, []):
                        if b not in best:
                            found[b] = min(found.get(b, best[a] + (b,)), best[a] + (b,))
                best |= found
                layer = list(found)
            want |= {(x, y, p) for y, p in best.items() if y != x and role[y][1]}
    got = graph.shortest_free_paths(nodes, edges).collect()
    assert {(r["source"], r["sink"], tuple(r["path"])) for r in got} == want and len(got) == len(want)
    assert all(r["hops"] == len(r["path"]) - 1 for r in got)
    blocks = graph.in_blocks(nodes.where("sink")).groupBy("block").count().collect()  # a row for each sink was the fault
    assert max(r["count"] for r in blocks) == 64 and all(r["count"] <= 64 for r in blocks)


def test_places_are_numbered_range_by_range(spark):
    """Items of more places than a range holds: numbers without gaps in order, and no window over all arrays in one task."""
    rows = spark.range(3_000).select((F.col("id") * 7919 % 1_000).alias("p"), (F.col("id") % 3).alias("q"), F.col("id").alias("x")).repartition(7)
    out = findings.items(rows, ["p", "q"], ["x"])
    got = sorted((r["p"], r["q"], r["number"], [f["x"] for f in r["findings"]]) for r in out.collect())
    assert [g[2] for g in got] == list(range(1, len(got) + 1)) and all(g[3] == sorted(g[3]) for g in got)
    assert sum(len(g[3]) for g in got) == 3_000
    plan = findings.items(rows, ["p", "q"], ["x"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and not any("findings" in line for line in windows)


def test_neighbourhood_is_a_search_and_shuffles_no_links_where_all_is_near(spark):
    """against a plain search, with owners and without; links aren't made distinct, and no round is done when nothing is left."""
    draw = random.Random(11)
    for owned in (False, True):
        ids = [f"n{i}" for i in range(40)]
        owner = {i: draw.choice([None, i, "n1", "o"]) if owned else None for i in ids[:36]}  # the last four are no nodes
        edges = [("g", draw.choice(ids), draw.choice(ids), draw.choice(["taint", "taint", "call", "sanitize"]), draw.choice([None, [], ["n3"], ["n5", "far", None]])) for _ in range(25)]
        ties = set()
        for _, a, b, kind, via in edges:
            a, b = owner.get(a) or a, owner.get(b) or b
            ties |= {(m, x) for m in via if m for x in (a, b)} if kind == "taint" and via else {(a, b)}
        ties = {x for u, v in ties if u != v for x in ((u, v), (v, u))}
        nodes = spark.createDataFrame([("g", i, o, False, False, False, "") for i, o in owner.items()], NODES)
        links = graph.owner_links(nodes, spark.createDataFrame(edges, EDGES))
        assert {tuple(r) for r in links.collect()} == ties
        assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()
        owners = nodes.select(F.coalesce("owner", "id").alias("id")).distinct()
        known = {r["id"] for r in owners.collect()}
        for start in ({"n3"}, {"n2", "n30", "n39"}, set(), known):
            for hops in (0, 1, 2, 3):
                want = start & known
                for _ in range(hops):
                    want = want | {v for u, v in ties if u in want}
                near = graph.neighbourhood(links, spark.createDataFrame([(i,) for i in start], "id string"), owners, hops)
                assert sorted(r["id"] for r in near.collect()) == sorted(want)
    all_ends = spark.createDataFrame([(x,) for x in {u for u, _ in ties} | known], "id string")
    written = len(graph.WRITTEN)
    assert graph.neighbourhood(links, all_ends, all_ends, 2).count() == all_ends.count() and len(graph.WRITTEN) == written + 2


def test_paths_are_found_by_bits_of_parts_and_not_by_edges(spark):
    """neighbours' messages are one row before a shuffle, and the edges are written as bits, repeated ones once."""
    ids = [f"n{i:03d}" for i in range(100)]
    sources, sinks = ids[:3], ids[90:93]
    edges = [t(a, b) for a in ids for b in ids if a != b and not (a in sources and b in sinks)] * 2
    g = build(spark, [*edges, t("lost", "n005"), ("n001", "n091", "call", ())], sources=(*sources, "lost"), sinks=sinks, sanitizers=("n004",))
    before = len(graph.WRITTEN)
    found = {(r["source"], r["sink"]): tuple(r["path"]) for r in graph.shortest_free_paths(g.nodes, g.edges).collect()}
    free = [i for i in ids if i not in sources and i not in sinks and i != "n004"]
    assert found == {(a, b): (a, free[0], b) for a in sources for b in sinks} | {("lost", b): ("lost", "n005", b) for b in sinks}
    tables = [spark.read.parquet(p) for p in graph.WRITTEN[before:] if list(Path(p.removeprefix("file://")).glob("*.parquet"))]
    assert max(x.count() for x in tables) < 1_000  # of 19,800 edges
    assert not any("src" in x.columns for x in tables)


def test_depths_that_bound_the_same_share_their_graphs(spark):
    """what a bound doesn't leave out isn't written or solved again; flags are those of each depth alone."""
    chain = [t(f"n{i}", f"n{i + 1}") for i in range(4)]
    before = build(spark, [t("s", "n0"), *chain], sinks=("n4",), digests={"n0": "old"})
    after = build(spark, [t("s", "n0"), *chain, t("s", "n4")], sinks=("n4",), digests={"n0": "new"})
    pairs = delta.bounded_by_depth(before, after, (0, 1, 2, 3, 4, 5, None))
    assert pairs[3] is pairs[4] is pairs[5] is pairs[None] and len({id(p) for p in pairs.values()}) == 4
    for h, rule in ((2, "R2"), (3, "R4")):
        found = delta.apply_rules(*pairs[h], None, ["R2", "R4"]).collect()
        assert sorted((r["rule"], r["a"], r["b"], tuple(r["detail"])) for r in found) == flags(before, after, h, ["R2", "R4"])
        assert [r["rule"] for r in found] == [rule]
    # an edge to what is no node is in the graph without a bound only
    loose = delta.Graph(before.nodes.where("id <> 'n4'"), before.edges)
    assert delta.dangling(loose) and not delta.dangling(before)
    pairs = delta.bounded_by_depth(loose, after, (5, None))
    assert pairs[5] is not pairs[None] and pairs[5][0].edges.count() == before.edges.count() - 1


def test_supplier_graph_reads_lines_once(spark, tmp_path):
    """lines that repeat a number, gaps and orders without a date, against joins; one shuffle of the lines."""
    from deltaloom.plans import adapters

    draw = random.Random(5)
    lines = [(draw.choice([None, *range(6)]), draw.choice([None, *range(1, 5)]), draw.choice([None, 3, 7, 10, 64, 130]), float(draw.randrange(9))) for _ in range(120)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    dates = [(i, "1995-01-01" if i % 3 == 0 else None if i % 3 == 1 else "1996-01-01") for i in range(5)]
    spark.createDataFrame(dates, "o_orderkey long, day string").selectExpr("o_orderkey", "cast(day as timestamp) o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    name = lambda x: f"s{x:06d}"
    want = {}
    for order, n, u, q in lines:
        for other, m, v, _ in lines:
            if order is not None and n is not None and order == other and m == n + 1 and None not in (u, v) and u != v and order < 5:
                makers = [x[2] for x in lines if x[0] == order and x[1] == n - 1] or [None]
                one = want.setdefault((dict(dates)[order], name(u), name(v)), [0.0, set()])
                for maker in makers:
                    one[0] += q
                    one[1].add(name(u if maker is None else maker))
    nodes, edges = adapters.supplier_graph(spark, str(tmp_path))
    rows = sorted((r["graph_id"], r["src"], r["dst"], r["kind"], r["weight"], *r["via"]) for r in edges.collect())
    assert rows == sorted(("before" if (day or "") == "1995-01-01" else "after", u, v, "sanitize" if v.endswith("3") else "taint", weight, *sorted(via)) for (day, u, v), (weight, via) in want.items())
    ids = {(g, x) for g, a, b, *_ in rows for x in (a, b)}
    assert sorted((r["graph_id"], r["id"]) for r in nodes.collect()) == sorted(ids)
    for r in nodes.collect():
        assert r["digest"] == ",".join(sorted(f"{b}:{k}" for g, a, b, k, *_ in rows if (g, a) == (r["graph_id"], r["id"])))
