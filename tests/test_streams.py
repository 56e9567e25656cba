"""Streams that take rows in order whatever order they come in, and what they refuse."""

from __future__ import annotations

import random

import pytest

from deltaloom.streaming import replay, turn_state

SCHEMA = "trace_id long, seed int, iteration int, side string, kind string, known string, digest string"


def run(spark, tmp_path, batches, strict=False):
    """Each batch as a file, one file a trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = replay.compared(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), strict)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def recorded(trace, turns):
    """turns: (kind, known, expected digest, digest seen)."""
    rows = [(trace, 0, 0, side, "init", None, None) for side in ("expected", "seen")]
    for i, (kind, known, a, b) in enumerate(turns, start=1):
        rows += [(trace, 0, i, "expected", kind, known, a), (trace, 0, i, "seen", kind, None, b)]
    return rows


def test_any_order_gives_the_ordered_result(spark, tmp_path):
    one = recorded(1, [("turn", "bad", "x", "x"), ("no-change", "clean", "y", "y"), ("turn", None, None, "z"), ("turn", "clean", "a", "b"), ("turn", None, "c", "c")])
    rows = one + recorded(2, [("turn", None, "x", "x")])
    random.Random(3).shuffle(rows)
    found = run(spark, tmp_path, [rows[:4], rows[4:9], rows[9:]])
    expected = [(1, 0, 1, "bad", "same"), (1, 0, 2, None, "same"), (1, 0, 3, "bad", "unchecked"), (1, 0, 4, "clean", "diverged"), (1, 0, 5, "clean", "after"), (2, 0, 1, "clean", "same")]
    assert sorted(map(tuple, found.collect())) == expected
    table = spark.createDataFrame(rows, SCHEMA)
    assert replay.complete(table, found).count() == 6
    more = table.union(spark.createDataFrame([(2, 0, 3, "seen", "turn", None, "q")], SCHEMA))
    with pytest.raises(ValueError, match="left over"):
        replay.complete(more, found)


class _State:
    def __init__(self):
        self.value, self.exists = None, False

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True


def fed(step, rows, key=(1, 0)):
    """What a state function gives for frames of rows, one after the other."""
    import pandas as pd

    state = _State()
    columns = SCHEMA.replace(" long", "").replace(" int", "").replace(" string", "").split(", ")
    return [r for batch in rows for out in step(key, iter([pd.DataFrame(batch, columns=columns)]), state) for r in out.itertuples(index=False)]


@pytest.mark.parametrize(
    "rows,message",
    [
        ([(1, 0, 0, "seen", "turn", None, "x")], "before init"),
        ([(1, 0, 2, "seen", "init", None, "x")], "in the middle"),
        ([(1, 0, 0, "seen", "init", None, "x"), (1, 0, 0, "seen", "init", None, "x")], "twice"),
        (recorded(1, [("turn", None, "x", "y")]), "diverged"),
        (recorded(1, [("turn", None, "x", "x")]) + recorded(1, [])[:1], "twice"),
    ],
)
def test_refusals_end_the_stream(rows, message):
    with pytest.raises(ValueError, match=message):
        fed(replay.comparer(True), [rows])
    if message == "diverged":
        assert [r.status for r in fed(replay.comparer(False), [rows])] == ["diverged"]


def test_queue_waits_over_triggers_and_diverging_kinds_count():
    rows = recorded(1, [("turn", "bad", None, None), ("turn", None, "a", "a")])
    assert [(r.iteration, r.label, r.status) for r in fed(replay.comparer(True), [[r] for r in reversed(rows)])] == [(1, "bad", "unchecked"), (2, "bad", "same")]
    other = [r if r[3] == "expected" or r[2] != 1 else (*r[:4], "no-change", *r[5:]) for r in rows]
    assert [r.status for r in fed(replay.comparer(False), [other])] == ["diverged", "after"]


def test_turn_state_refuses_repeats():
    import pandas as pd

    state, frame = _State(), lambda *i: pd.DataFrame({"iteration": i, "role": "introducing", "present": True, "decision": "ALLOW"})
    assert [len(f) for f in turn_state._advance((1, 0, "A"), iter([frame(3, 2)]), state)] == [0]
    assert [f["iteration"].tolist() for f in turn_state._advance((1, 0, "A"), iter([frame(1)]), state)] == [[1, 2, 3]]
    for again in (2, 0):
        with pytest.raises(ValueError):
            list(turn_state._advance((1, 0, "A"), iter([frame(again)]), state))


def judged_rows(traces):
    """(trace_id, seed, condition, iteration, role, present, decision) of replications that differ, a trace without a number among them."""
    roles = {"clean": False, "introducing": True, "persisting": True, "no-change": False}
    draw = random.Random(7)
    return [(t, s, c, i, role, roles[role], None if role == "no-change" else draw.choice(["BLOCK", "ALLOW"])) for t in traces for s in (0, None) for c in "AB" for i in range(1, 6) for role in [draw.choice(list(roles))]]


def test_replications_share_calls_and_states(spark, tmp_path):
    """a call of the state function and a row of state for 16 traces, not for each replication and condition."""
    from deltaloom.operators import turns

    schema = "trace_id long, seed int, condition string, iteration int, role string, present boolean, decision string"
    rows = judged_rows([*range(20), 10**15, -1, None])
    table = spark.createDataFrame(rows, schema)
    want = sorted(map(str, turns.caught(table).select("trace_id", "seed", "condition", "iteration", "caught", "surviving").collect()))
    random.Random(3).shuffle(rows)
    for part in (rows[::3], rows[1::3], rows[2::3]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = turn_state.turn_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())) == want
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 5  # traces 0-15, 16-19, 10**15, -1 and null


def test_compared_replications_share_calls_and_states(spark, tmp_path):
    """many replications in a call, a row of state for 16 traces; turns behind a gap keep their verdict and not both digests."""
    rows, want = [], []
    for trace in (0, 1, 15, 16, -1):
        rows += recorded(trace, [("turn", "bad", "d" * 64, "d" * 64), ("turn", None, "x", "y" if trace == 1 else None)])
        want += [(trace, 0, 1, "bad", "same"), (trace, 0, 2, "bad", "diverged" if trace == 1 else "unchecked")]
    found = run(spark, tmp_path, [rows[::2], rows[1::2]])
    assert sorted(map(tuple, found.collect())) == sorted(want)
    state, step = _State(), replay.comparer(False)
    import pandas as pd

    frame = lambda rows: iter([pd.DataFrame(rows, columns=["trace_id", "seed", "iteration", "side", "kind", "known", "digest"])])
    late = [r for r in rows if r[2] == 1]
    assert [len(f) for f in step((0,), frame(late), state)] == [0] and "d" * 64 not in state.get[0]
    with pytest.raises(ValueError, match="twice"):
        list(step((0,), frame(late[:1]), state))
    assert [len(f) for f in step((0,), frame([r for r in rows if r[2] != 1]), state)] == [10]


def test_a_stream_is_checked_for_leftovers_by_what_it_was_given(spark):
    """the rows are worked out once, written, and read again."""
    from deltaloom.plans.turn_queries import streamed

    rows = spark.createDataFrame(recorded(1, [("turn", "bad", "x", "x")]) + recorded(2, [("turn", None, "x", None)])[:3], SCHEMA)
    given, found = streamed(rows, "replay", replay.compared)
    assert sorted(map(str, given.collect())) == sorted(map(str, rows.collect())) and given.inputFiles() and found.count() == 1
    with pytest.raises(ValueError, match="left over"):
        replay.complete(given, found)


def test_what_is_left_over_is_found_without_a_broadcast(spark):
    """turns are a small file and a large table; the driver doesn't hold them, and where counts agree nothing is joined."""
    from deltaloom.streaming import replay

    rows = [(1, 0, i, side, "init" if i == 0 else "turn") for i in range(4) for side in ("expected", "seen")]
    columns = "trace_id long, seed int, iteration int, side string, kind string"
    records = spark.createDataFrame(rows, columns)
    found = spark.range(1, 4).selectExpr("1L AS trace_id", "0 AS seed", "cast(id AS int) AS iteration")  # known to be small
    plan = replay.leftovers(records, found)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert replay.complete(records, found) is found
    with pytest.raises(ValueError, match="left over: .*'iteration': 3"):
        replay.complete(records, found.where("iteration < 3"))
    # as many rows as the counts ask for, one of them without a kind, are not taken for a whole
    odd = records.where("iteration < 3").union(spark.createDataFrame([(1, 0, 3, "seen", "turn"), (1, 0, 3, "seen", None)], columns))
    with pytest.raises(ValueError, match="left over"):
        replay.complete(odd.union(spark.createDataFrame([(1, 0, 4, "seen", "turn")], columns)), found.where("iteration < 3"))
