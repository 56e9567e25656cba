"""Exact paired statistics. Shares stay pairs of integers until the last step, so ties are real ties."""

from __future__ import annotations

import random
from collections.abc import Iterator
from math import ceil, floor, ldexp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_event_recall(rows: DataFrame) -> DataFrame:
    return rows.where("role = 'introducing'").groupBy("condition", "trace_id").agg(F.count(F.when(F.col("decision") == "BLOCK", 1)).alias("blocked"), F.count("*").alias("introduced"))


def paired(recall: DataFrame, a: str, b: str, key: str = "trace_id") -> DataFrame:
    """(key, num, den): recall of ``b`` less that of ``a`` as an exact fraction; an event without its partner is an error."""
    left = recall.where(F.col("condition") == a).select(key, F.col("blocked").alias("p"), F.col("introduced").alias("m"))
    right = recall.where(F.col("condition") == b).select(key, F.col("blocked").alias("q"), F.col("introduced").alias("n"))
    rows = left.join(right, key, "full_outer")
    whole = F.when(F.col("m").isNull() | F.col("n").isNull(), F.raise_error(F.lit("an event lacks one of the two conditions")).cast("long"))
    return rows.select(key, F.coalesce(whole, F.col("q") * F.col("m") - F.col("p") * F.col("n")).alias("num"), (F.col("m") * F.col("n")).alias("den"))


def signed_ranks(pairs: DataFrame, key: str = "trace_id") -> DataFrame:
    """(key, sign, rank2): twice the average rank of the size of each difference that isn't zero; equal fractions tie."""
    size = F.abs(F.col("num")).cast("double") / F.col("den")  # equal fractions of small integers are equal doubles
    rows = pairs.where("num <> 0").withColumn("size", size)
    rank2 = 2 * F.rank().over(Window.orderBy("size")) + F.count("*").over(Window.partitionBy("size")) - 1
    return rows.select(key, F.signum("num").cast("int").alias("sign"), rank2.cast("long").alias("rank2"))


def signs_below(ranks: list[int], low: int) -> float:
    """Twice the share of all signs whose sum of ranks is at most ``low``, 1 at most.

    Sets are counted by their sum in an array of doubles that ends at ``low``. All terms are positive, so that the share is
    right up to one rounding for each rank, and exactly so while counts are below 2**53; a power of two is kept apart."""
    ways, reach, power = np.zeros(low + 1), 0, 0
    ways[0] = 1.0
    for i, r in enumerate(sorted(ranks)):
        if r > low:
            break
        reach = min(low, reach + r)
        ways[r : reach + 1] += ways[: reach + 1 - r].copy()
        if i % 64 == 63 and ways[: reach + 1].max() > 2.0**700:  # 64 ranks double it 64 times at most
            ways[: reach + 1] *= 2.0**-700
            power += 700
    return min(1.0, ldexp(float(ways.sum()), power + 1 - len(ranks)))


def wilcoxon(ranks: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row: pairs, zero_dropped, pairs_used, w_plus2, w_minus2 (twice the rank sums), p (exact, two-sided), rank_biserial.

    ``pairs`` are all differences, of which those that are zero have no rank. The distribution of the smaller sum over all
    signs is counted by the number of subsets for each sum, in one task over one row for each rank: the time is that of
    (ranks * smaller sum) additions, the memory that of the smaller sum.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames)
        ranks, signs = [int(x) for x in rows["rank2"].dropna()], rows["sign"].dropna().tolist()
        total, plus = sum(ranks), sum(r for r, s in zip(ranks, signs) if s > 0)
        p = signs_below(ranks, min(plus, total - plus)) if ranks else 1.0
        effect = (2 * plus - total) / total if total else 0.0
        yield pd.DataFrame({"pairs": [len(rows)], "zero_dropped": [len(rows) - len(ranks)], "pairs_used": [len(ranks)], "w_plus2": [plus], "w_minus2": [total - plus], "p": [p], "rank_biserial": [effect]})

    rows = ranks.select("sign", "rank2")
    if pairs is not None:
        rows = rows.unionByName(pairs.where("num = 0").select(F.lit(None).cast("int").alias("sign"), F.lit(None).cast("long").alias("rank2")))
    return rows.coalesce(1).mapInPandas(count, "pairs long, zero_dropped long, pairs_used long, w_plus2 long, w_minus2 long, p double, rank_biserial double")


def holm(tests: DataFrame, p: str = "p", family: str | None = None) -> DataFrame:
    """Adds adjusted: the running maximum of (m - rank + 1) * p, at most 1, inside each family of tests."""
    groups = [family] if family else []
    order = Window.partitionBy(*groups).orderBy(p, *[c for c in tests.columns if c not in (p, *groups)])
    raw = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(*groups)) - F.row_number().over(order) + 1) * F.col(p))
    rows = tests.withColumn("_raw", raw)
    return rows.withColumn("adjusted", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def drawn_places(n: int, seed: int, many: int = 1_000_000) -> Iterator[np.ndarray]:
    """What ``random.Random(seed).randrange(n)`` gives, call after call, in arrays: the same generator's 32-bit words, of which the
    first bits are a place unless they are too large."""
    bits = n.bit_length()
    if bits > 32:
        raise ValueError("more values than a word of the generator can number")
    _, state, _ = random.Random(seed).getstate()
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    while True:
        drawn = words.random_raw(many) >> np.uint64(32 - bits)
        yield drawn[drawn < n].astype(np.int64)


def resampled_means(data: list[float], resamples: int, seed: int) -> list[float]:
    """The mean of each resample. Draws and places are arrays; a resample is summed as Python sums floats."""
    n, values, left, out = len(data), np.array(data), np.empty(0, np.int64), []
    stream = drawn_places(n, seed)
    while len(out) < resamples:
        parts, have = [left], len(left)
        while have < n:
            parts.append(next(stream))
            have += len(parts[-1])
        places = np.concatenate(parts)
        whole = min(have // n, resamples - len(out))
        for i in range(whole):
            out.append(sum(values[places[i * n : (i + 1) * n]].tolist()) / n)
        left = places[whole * n :]
    return out


def bootstrap(values: DataFrame, group: str, value: str, order: str, resamples: int = 10_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(group, mean, low, high): a seeded percentile bootstrap of the mean, with Python's own generator.

    Values are drawn one by one by their place in ``order``, so the interval depends on it. A null value is an error.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        data = frame.sort_values(order)[value].astype(float).tolist()
        if not data or any(x != x for x in data):
            raise ValueError("no values to resample")
        n, means = len(data), sorted(resampled_means(data, resamples, seed))
        low, high = means[floor((1 - level) / 2 * resamples)], means[ceil((1 + level) / 2 * resamples) - 1]
        return pd.DataFrame({group: [frame[group].iloc[0]], "mean": [sum(data) / n], "low": [low], "high": [high]})

    kind = values.schema[group].dataType.simpleString()
    return values.select(group, value, order).groupBy(group).applyInPandas(run, f"`{group}` {kind}, mean double, low double, high double")


def upper_median(value: Column) -> Column:
    """The element at n div 2 of the sorted values, which isn't the interpolated median."""
    return F.get(F.array_sort(F.collect_list(value)), F.floor(F.count(value) / 2).cast("int"))
