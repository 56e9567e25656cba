"""The state of replications over a stream of judged turns: what the batch window computes, turn by turn.

State is kept for each (trace_id, seed, condition): whether the present regression is caught, the last iteration, and turns that
came early. Turns of a replication are numbered from 1 without gaps and are taken in that order, so files may come in any order;
a turn that comes twice is an error. A call of the state function costs milliseconds whatever it is given, so the replications
of 16 neighbouring traces share a call and a state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ("trace_id", "seed", "condition")
OUT = "trace_id long, seed int, condition string, iteration int, caught boolean, surviving boolean"
#: [*key, caught, last, waiting] of each replication; ``waiting`` has iteration and marks, in turn, of turns in front of which one is missing.
STATE = "replications string"
CLEAN, PRESENT, BLOCKED = 1, 2, 4


def none(value):
    """Nulls as pandas has them, as None."""
    return None if value is None or value != value else value


def in_blocks(rows: DataFrame) -> DataFrame:
    """Adds block: the same for 16 neighbouring traces, so that a block's state stays as small as theirs however many there are."""
    return rows.withColumn("block", F.shiftright("trace_id", 4))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """For any replications at once; frames without their columns are of the one that ``key`` names."""
    held, own = {}, dict(zip(KEYS, key))
    for *name, caught, last, waiting in json.loads(state.get[0]) if state.exists else ():
        held[tuple(name)] = [caught, last, dict(zip(waiting[::2], waiting[1::2]))]
    for frame in frames:
        names = [frame[c].tolist() if c in frame else repeat(own[c]) for c in KEYS]
        for trace, seed, condition, i, role, present, decision in zip(*names, *(frame[c].tolist() for c in ("iteration", "role", "present", "decision"))):
            name = (none(trace), None if none(seed) is None else int(seed), none(condition))
            if name not in held:
                held[name] = [False, 0, {}]
            _, last, queue = held[name]
            i = int(i)
            if i <= last or i in queue:
                raise ValueError(f"turn {i} of {name} comes twice, or before the first")
            queue[i] = CLEAN * (role == "clean") + PRESENT * bool(present) + BLOCKED * (decision == "BLOCK")
    out = []
    for name, one in held.items():
        caught, last, queue = one
        while last + 1 in queue:
            last += 1
            marks = queue.pop(last)
            present = bool(marks & PRESENT)
            if marks & CLEAN:
                caught = False
            if present and marks & BLOCKED:
                caught = True
            out.append((*name, last, present and caught, present and not caught))
        one[:2] = caught, last
    rows = [[*name, caught, last, [x for pair in sorted(queue.items()) for x in pair]] for name, (caught, last, queue) in held.items()]
    state.update((json.dumps(rows, separators=(",", ":")),))
    yield pd.DataFrame(out, columns=[*KEYS, "iteration", "caught", "surviving"])


def turn_states(judged: DataFrame) -> DataFrame:
    """A stream of (trace_id, seed, condition, iteration, role, present, decision) -> caught and surviving of each turn."""
    rows = in_blocks(judged.select(*KEYS, "iteration", "role", "present", "decision"))
    return rows.groupBy("block").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_outcomes(judged: DataFrame, time: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of decisions in tumbling windows of event time; rows later than the watermark are left out."""
    return judged.withWatermark(time, late).groupBy(F.window(time, width), "condition").agg(
        F.count("*").alias("turns"), F.count(F.when(F.col("decision") == "BLOCK", 1)).alias("blocks")
    )


def upsert_each_batch(stream: DataFrame, write, checkpoint: str):
    """Start ``stream`` with ``write(batch, number)`` for each micro-batch; a repeated number must be idempotent there."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
