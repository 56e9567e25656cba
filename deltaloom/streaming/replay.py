"""A recorded run checked against the run that repeats it, as a stream: in order for each replication, whatever order rows come in.

Rows: trace_id, seed, iteration, side (``expected`` or ``seen``), kind (``init`` at iteration 0, else a turn's kind), known (a
label or null) and digest (of what was asked for). A replication's state holds the next iteration, the label carried so far,
rows whose other side is still to come, and what turns are whose sides were both there before an earlier turn was. A turn is
taken when all before it were and both sides are there, so any number of files in any order gives what one ordered file does.
The replications of 16 neighbouring traces share a call and a state, as in ``turn_state``.

A turn of an uninitialised replication, an init elsewhere than at 0, and a row that repeats one are errors. A turn whose digest or
kind differs is ``diverged``, or ends the stream if that is ``strict``; what follows it is ``after``. A row without a digest on
either side can't be compared and is ``unchecked``. What is never taken is left over: see ``leftovers``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .turn_state import in_blocks, none

KEYS = ("trace_id", "seed")
OUT = "trace_id long, seed int, iteration int, label string, status string"
#: [*key, next, label, broken, waiting, ready] of each replication. ``waiting``: [iteration, side, kind, known, digest] of rows without
#: their other side; ``ready``: [iteration, kind, known, status, how it has diverged or null] of turns behind a gap.
STATE = "replications string"
_ROW = ("iteration", "side", "kind", "known", "digest")
_SIDES = ("expected", "seen")


def _verdict(expected: tuple, seen: tuple) -> tuple:
    (kind, known, digest), (again, _, other) = expected, seen
    if kind != again or (digest is not None and other is not None and digest != other):
        return kind, known, "diverged", f"{digest} is {other}"
    return kind, known, "unchecked" if digest is None or other is None else "same", None


def comparer(strict: bool) -> Callable:
    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {}
        for trace, seed, following, label, broken, waiting, ready in json.loads(state.get[0]) if state.exists else ():
            held[trace, seed] = [following, label, broken, {(i, side): tuple(rest) for i, side, *rest in waiting}, {i: rest for i, *rest in ready}]
        for frame in frames:
            for trace, seed, i, side, kind, known, digest in zip(*(frame[c].tolist() for c in (*KEYS, *_ROW))):
                name = (none(trace), None if none(seed) is None else int(seed))
                if name not in held:
                    held[name] = [0, "clean", False, {}, {}]
                following, _, _, waiting, ready = held[name]
                i = int(i)
                if (i == 0) != (kind == "init"):
                    raise ValueError(f"{'a turn before init' if i == 0 else 'init in the middle'} of {name}")
                if i < following or (i, side) in waiting or (i in ready and side in _SIDES):
                    raise ValueError(f"turn {i} of {name} is {side} twice")
                waiting[i, side] = (kind, none(known), none(digest))
                if all((i, x) in waiting for x in _SIDES):
                    ready[i] = _verdict(*(waiting.pop((i, x)) for x in _SIDES))
        out = []
        for name, one in held.items():
            following, label, broken, _, ready = one
            while following in ready:
                kind, known, status, how = ready.pop(following)
                if status == "diverged" and strict and not broken:
                    raise ValueError(f"turn {following} of {name} has diverged: {how}")
                if kind == "turn":
                    label = known or label
                if following:
                    out.append((*name, following, label if kind == "turn" else None, "after" if broken else status))
                broken = broken or status == "diverged"
                following += 1
            one[:3] = following, label, broken
        rows = [[*name, *one, [[*at, *rest] for at, rest in sorted(waiting.items())], [[i, *rest] for i, rest in sorted(ready.items())]] for name, (*one, waiting, ready) in held.items()]
        state.update((json.dumps(rows, separators=(",", ":")),))
        yield pd.DataFrame(out, columns=[*KEYS, "iteration", "label", "status"])

    return step


def compared(records: DataFrame, strict: bool = False) -> DataFrame:
    """A stream of rows -> trace_id, seed, iteration, label, status of every turn, in order for each replication."""
    rows = in_blocks(records.select(*KEYS, *_ROW))
    return rows.groupBy("block").applyInPandasWithState(comparer(strict), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def leftovers(records: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``records`` (a table) that the stream never took: turns that only one side has, and what comes behind a gap.
    Both sides are sorted: turns take so little room in files that they would be taken for a small table, and be held by the driver."""
    return records.where("kind <> 'init'").join(found.select(*KEYS, "iteration").hint("merge"), [*KEYS, "iteration"], "left_anti")


def complete(records: DataFrame, found: DataFrame) -> DataFrame:
    """``found``, if nothing is left over; else an error that names one row. A turn that was taken is one row of each side, and
    none comes twice, so nothing is left over where the counts agree, and nothing is joined."""
    if records.where("NOT kind <=> 'init'").count() == 2 * found.count():
        return found
    first = leftovers(records, found).select(*KEYS, "iteration", "side").limit(1).collect()
    if first:
        raise ValueError(f"left over: {first[0].asDict()}")
    return found
