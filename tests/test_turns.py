"""Turn state and measures on scripted replications, and statistics against enumeration."""

from __future__ import annotations

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from deltaloom.operators import measures, stats, turns

SCHEMA = "trace_id long, seed int, iteration int, kind string, known string, score double, basis string, scope string, vulnerability_class string, seconds double, tokens long"


def script(spark, *replications):
    """Replications as strings: c clean, r regressed, . carried, - no change; upper case is blocked at 10."""
    rows = []
    for i, text in enumerate(replications):
        for n, ch in enumerate(text, start=1):
            known = {"c": "clean", "r": "bad"}.get(ch.lower())
            rows.append((i, 0, n, "no-change" if ch == "-" else "turn", known, 20.0 if ch.isupper() or ch == ":" else 1.0, "carried" if ch in ".:" else "known", "local", "sql", 1.0 * n, n))
    df = turns.roles(turns.carried_labels(spark.createDataFrame(rows, SCHEMA)))
    return turns.judged(df, spark.createDataFrame([("X", 10.0)], "condition string, threshold double"), F.col("score"))


def walk(text):
    """The same by a state machine."""
    label, caught, out = "clean", False, []
    for ch in text:
        if ch == "-":
            out.append((None, False, False))
            continue
        label = {"c": "clean", "r": "bad"}.get(ch.lower(), label)
        present = label != "clean"
        if not present:
            caught = False
        elif ch.isupper() or ch == ":":
            caught = True
        out.append((label, present and caught, present and not caught))
    return out


TEXTS = ["crr:.c.r", "r..:..", "-r-:-.", "cccc", "", "C:r-:cR.", "....", "rrRRcrr"]


def test_labels_and_caught(spark):
    rows = turns.caught(script(spark, *TEXTS)).collect()
    got = {(r["trace_id"], r["iteration"]): (r["label"], r["caught"], r["surviving"]) for r in rows}
    assert got == {(i, n): w for i, t in enumerate(TEXTS) for n, w in enumerate(walk(t), start=1)}


def test_detections_end_with_the_regression(spark):
    rows = turns.detections(script(spark, "crr:", "r-:", "rc:", "R", "r.rcR")).collect()
    got = sorted((r["trace_id"], r["introduced_at"], r["delay"]) for r in rows)
    assert got == [(0, 2, 2), (1, 1, None), (2, 1, None), (3, 1, 0), (4, 1, None), (4, 5, 0)]


def test_curve_keeps_last_state(spark):
    rows = turns.survival_curve(turns.caught(script(spark, "r", "cr:", "ccc", "crr"))).orderBy("iteration").collect()
    assert [(r["iteration"], r["surviving"], r["running"]) for r in rows] == [(1, 1, 4), (2, 3, 3), (3, 2, 3)]


def test_measures(spark):
    rows = script(spark, "crr:", "Cr", "R", "c-C")
    recall = {(r["condition"], r["scope"]): (r["introduced"], r["blocked"]) for r in measures.recall_at_introduction(rows).where("vulnerability_class IS NULL").collect()}
    assert recall == {("X", None): (3, 1), ("X", "local"): (3, 1)}
    f = measures.false_blocks(rows).first()
    assert (f["clean_turns"], f["clean_blocked"], f["blocks"], f["true_blocks"]) == (4, 2, 4, 2) and f["precision"] == 0.5
    assert measures.inventory(rows).first()["no_change"] == 1
    assert measures.false_blocks(script(spark, "")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_wilcoxon_is_enumeration(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, rng.randint(-4, 4), rng.choice([1, 2, 3, 4, 6])) for i in range(9)]
    ranks = stats.signed_ranks(spark.createDataFrame(pairs, "trace_id long, num long, den long"))
    got = stats.wilcoxon(ranks).first()
    sizes = [abs(Fraction(n, d)) for _, n, d in pairs if n]
    rank2 = [2 * sum(x < s for x in sizes) + sum(x == s for x in sizes) + 1 for s in sizes]
    plus = sum(r for r, (_, n, _) in zip(rank2, [p for p in pairs if p[1]]) if n > 0)
    low = min(plus, sum(rank2) - plus)
    below = sum(sum(r for r, s in zip(rank2, signs) if s) <= low for signs in itertools.product([0, 1], repeat=len(rank2)))
    assert (got["pairs"], got["w_plus2"]) == (len(rank2), plus)
    all_pairs = spark.createDataFrame(pairs, "trace_id long, num long, den long")
    full = stats.wilcoxon(ranks, all_pairs).first()
    assert (full["pairs"], full["zero_dropped"], full["pairs_used"], full["p"]) == (9, 9 - len(rank2), len(rank2), got["p"])
    assert full["rank_biserial"] == ((2 * plus - sum(rank2)) / sum(rank2) if rank2 else 0)
    assert got["p"] == min(1.0, 2 * below / 2 ** len(rank2))


def test_pairing_needs_both(spark):
    recall = spark.createDataFrame([("B", 1, 1, 2), ("C", 1, 1, 1), ("B", 2, 0, 1)], "condition string, trace_id long, blocked long, introduced long")
    with pytest.raises(Exception, match="lacks one"):
        stats.paired(recall, "B", "C").collect()
    assert [tuple(r) for r in stats.paired(recall.where("trace_id = 1"), "B", "C").collect()] == [(1, 1, 2)]


def test_holm_and_bootstrap(spark):
    rows = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double")).orderBy("t").collect()
    assert [round(r["adjusted"], 6) for r in rows] == [0.03, 0.06, 0.06]
    data = [0.0, 0.5, 1.0, 1.0]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(data)], "g string, i int, v double").repartition(3)
    got = stats.bootstrap(df, "g", "v", "i", resamples=500).first()
    rng = random.Random(0)
    means = sorted(sum(data[rng.randrange(4)] for _ in data) / 4 for _ in range(500))
    assert (got["mean"], got["low"], got["high"]) == (0.625, means[12], means[487])
    # the values of a seeded generator that draws by place, not by size
    eight = [0.9, 0.1, 0.5, 0.3, 0.8, 0.0, 0.7, 0.449]
    got = stats.bootstrap(spark.createDataFrame([("g", i, x) for i, x in enumerate(eight)], "g string, i int, v double"), "g", "v", "i").first()
    rng = random.Random(0)
    means = sorted(sum(eight[rng.randrange(8)] for _ in range(8)) / 8 for _ in range(10_000))
    assert (got["low"], got["high"]) == (means[250], means[9749])
    with pytest.raises(Exception, match="no values"):
        stats.bootstrap(spark.createDataFrame([("g", 1, None)], "g string, i int, v double"), "g", "v", "i").collect()
    assert spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int").agg(stats.upper_median(F.col("x"))).first()[0] == 3


def test_bootstrap_query_runs_all_resamples(spark):
    from deltaloom.plans import turn_queries

    small = "/root/testdata/sf0.001"
    data: dict[str, list[float]] = {}
    for r in turn_queries.per_event_recall(spark, small).orderBy("trace_id").collect():
        data.setdefault(r["condition"], []).append(r["blocked"] / r["introduced"])
    want = {}
    for condition, values in data.items():
        rng, n = random.Random(0), len(values)
        means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(10_000))
        want[condition] = (means[250], means[9749])
    assert {r["condition"]: (r["low"], r["high"]) for r in turn_queries.bootstrap_ci(spark, small).collect()} == want


def test_stream_is_batch(spark, tmp_path):
    from deltaloom.streaming.turn_state import turn_states

    batch = turns.caught(script(spark, *TEXTS))
    for n in (1, 2):  # two files, the second later
        batch.where(f"iteration {'<=' if n == 1 else '>'} 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = turn_states(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    columns = ["trace_id", "iteration", "caught", "surviving"]
    key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000, 70_000])
def test_resampling_draws_what_python_draws(n):
    import random
    from itertools import islice

    from deltaloom.operators import stats

    rng = random.Random(5)
    wanted = [rng.randrange(n) for _ in range(3_000)]
    got = [int(x) for part in islice(stats.drawn_places(n, 5, 1_000), 20) for x in part][:3_000]
    assert got == wanted
    if n < 1_000:
        data, rng = [1 / (i + 3) for i in range(n)], random.Random(9)
        assert stats.resampled_means(data, 50, 9) == [sum(data[rng.randrange(n)] for _ in range(n)) / n for _ in range(50)]


def test_signs_are_counted_as_integers_are():
    """Against whole numbers; the counts of 1,500 ranks don't fit a double."""
    from deltaloom.operators import stats

    rng = random.Random(4)
    for n, top in ((5, 9), (40, 60), (1_500, 12)):
        ranks = [rng.randrange(1, top) for _ in range(n)]
        ways = [1]
        for r in ranks:
            ways = [a + b for a, b in zip([*ways, *[0] * r], [*[0] * r, *ways])]
        for low in (0, 1, sum(ranks) // 3, sum(ranks) * 2 // 5, sum(ranks) // 2):
            want = min(1.0, 2 * sum(ways[: low + 1]) / 2**n)
            assert stats.signs_below(ranks, low) == pytest.approx(want, rel=1e-12, abs=1e-300) and (n > 40 or stats.signs_below(ranks, low) == want)
