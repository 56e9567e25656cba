"""Near-duplicate pairs against all pairs, running totals, and the budget stop."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from deltaloom.operators import similarity as sim
from deltaloom.operators import states as st


def units(rng, n, first):
    out = []
    for i in range(n):
        words = [rng.choice("abcdefghijkl" if rng.random() < 0.7 else "xyz") for _ in range(rng.randint(0, 30))]
        if out and rng.random() < 0.5:
            words = list(rng.choice(out)[2])
            for _ in range(rng.randint(0, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice("abcq"))
        out.append((first + i, rng.choice(["f", "f", "g"]), words))
    return out


@pytest.mark.parametrize("seed,percent,least", [(0, 80, 1), (1, 60, 5), (2, 20, 3), (3, 100, 1)])
def test_near_pairs_are_all_pairs(spark, seed, percent, least):
    rng = random.Random(seed)
    a = units(rng, 40, 0)
    b = [(1_000 + i, k, w) for i, k, w in units(rng, 40, 0)] + [(2_000 + i, k, w) for i, k, w in a[:10]]
    expected = set()
    for i, k, x in a:
        for j, other, y in b:
            if k == other and len(x) >= least and len(y) >= least:
                common = sum((Counter(x) & Counter(y)).values())
                if 200 * common >= percent * (len(x) + len(y)):
                    expected.add((i, j, k, common, len(x) + len(y)))
    frames = [spark.createDataFrame(rows, f"{key} long, kind string, words array<string>") for rows, key in ((a, "u"), (b, "c"))]
    got = sim.near_pairs(*frames, "u", "c", "kind", "words", percent, least).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and expected
    if not seed:
        ratio = {(r["u"], r["c"]): r["ratio"] for r in sim.near_duplicates(*frames, "u", "c", "kind", "words", percent, least).collect()}
        assert set(ratio) <= {e[:2] for e in expected} and {(i, 2_000 + i) for i, _, w in a[:10] if w} <= set(ratio) and min(ratio.values()) >= 0.8


def test_near_pairs_in_blocks_where_the_candidates_are(spark, monkeypatch):
    rng = random.Random(9)
    a, b = units(rng, 30, 0), [(1_000 + i, k, [*w, None] if i % 2 else w) for i, k, w in units(rng, 30, 0)]
    frames = [spark.createDataFrame(rows, f"{key} long, kind string, words array<string>") for rows, key in ((a + [(None, "f", ["a"])], "u"), (b + [(7, None, ["a"]), (8, "new", ["a"])], "c"))]
    whole = sim.near_pairs(*frames, "u", "c", "kind", "words", 20, 1)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # pairs of candidates and units don't meet in a shuffle
    monkeypatch.setattr(sim, "BLOCK_TOKENS", 60)
    expected = set()
    for i, k, x in a:
        for j, other, y in b:
            y = [w for w in y if w]
            common = sum((Counter(x) & Counter(y)).values())
            if k == other and common and 10 * common >= len(x) + len(y):
                expected.add((i, j, k, common, len(x) + len(y)))
    assert sorted(map(tuple, sim.near_pairs(*frames, "u", "c", "kind", "words", 20, 1).collect())) == sorted(map(tuple, whole.collect())) == sorted(expected)


def test_near_pairs_of_nothing(spark):
    none = [spark.createDataFrame([(1, "f", [])], f"{key} long, kind string, words array<string>") for key in "uc"]
    assert sim.near_pairs(*none, "u", "c", "kind", "words").isEmpty()


def test_running_totals_over_ranges(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 9)) for i in rng.sample(range(1_000), 300)]
    got = {r["k"]: r["front"] for r in st.running_totals(spark.createDataFrame(rows, "k long, v long").repartition(5), ["k"], "v", "front").collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}


@pytest.mark.parametrize("budget,ran,following", [(0, 0, "a"), (1, 1, "b"), (2, 1, "b"), (3, 2, "c"), (4, 4, None)])
def test_budget_stops_in_front_of_a_group(spark, budget, ran, following):
    rows = [("a", "1"), ("a", "2"), ("a", "1"), ("b", "2"), ("b", "3"), ("c", "1"), ("c", "known"), ("d", "4"), (None, "5")]
    cached = spark.createDataFrame([("known",), ("known",)], "key string")
    groups = st.admitted(spark.createDataFrame(rows, "trace string, key string"), "trace", "key", budget, cached)
    assert {r["trace"]: (r["requests"], r["calls"], r["before"]) for r in groups.collect()} == {"a": (3, 2, 0), "b": (2, 1, 2), "c": (2, 0, 3), "d": (1, 1, 3)}
    row = st.stopped(groups).first()
    assert (row["complete"], row["ran"], row["next"]) == (following is None, ran, following)
