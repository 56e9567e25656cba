"""Ordered state over the turns of a replication: labels carried forward, roles, decisions, what was caught.

A *turn* row has trace_id, seed, iteration; a replication is one (trace_id, seed). All of these are window functions over
replications, so a table is shuffled once by replication however many of them are chained.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLICATION = ("trace_id", "seed")


def _ordered(*more: str) -> Window:
    return Window.partitionBy(*REPLICATION, *more).orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)


def carried_labels(turns: DataFrame) -> DataFrame:
    """Adds label and introduced to rows with ``kind`` and ``known`` (a label, or null where the turn's basis is unknown).

    Only rows of kind 'turn' have labels: the last known one, 'clean' before any; a label is introduced where the turn
    before was clean and this one is not.
    """
    turn = F.col("kind") == "turn"
    label = F.when(turn, F.coalesce(F.last(F.when(turn, F.col("known")), ignorenulls=True).over(_ordered()), F.lit("clean")))
    rows = turns.withColumn("label", label)
    before = F.coalesce(F.last("label", ignorenulls=True).over(Window.partitionBy(*REPLICATION).orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)), F.lit("clean"))
    return rows.withColumn("introduced", F.coalesce((before == "clean") & (F.col("label") != "clean"), F.lit(False)))


def roles(turns: DataFrame) -> DataFrame:
    """Adds role: no-change, clean, introducing or persisting; and present, whether the regression is there."""
    role = F.when(F.col("label").isNull(), "no-change").when(F.col("label") == "clean", "clean").when(F.col("introduced"), "introducing").otherwise("persisting")
    return turns.withColumn("role", role).withColumn("present", F.col("role").isin("introducing", "persisting"))


def judged(turns: DataFrame, policies: DataFrame, score: Column) -> DataFrame:
    """Every turn under every policy (condition, threshold): BLOCK above the threshold, a null threshold never blocks;
    rows without a change have no decision. ``policies`` is a small parameter table."""
    rows = turns.join(F.broadcast(policies))  # each turn once for each of a handful of policies: the operator's definition
    decision = F.when(F.col("role") == "no-change", F.lit(None)).when(score > F.col("threshold"), "BLOCK").otherwise("ALLOW")
    return rows.withColumn("decision", decision)


def caught(rows: DataFrame) -> DataFrame:
    """Adds caught and surviving. A block on a present turn catches the regression until a judged clean turn; turns
    without a change keep the state, but read as neither."""
    over = _ordered("condition")
    rows = rows.withColumn("_clean", F.sum(F.when(F.col("role") == "clean", 1).otherwise(0)).over(over))
    hit = F.max((F.coalesce(F.col("decision") == "BLOCK", F.lit(False)) & F.col("present")).cast("int")).over(_ordered("condition", "_clean")) == 1
    return rows.withColumn("caught", F.col("present") & hit).withColumn("surviving", F.col("present") & ~hit).drop("_clean")


def detections(rows: DataFrame) -> DataFrame:
    """(trace_id, seed, condition, introduced_at, caught_at, delay): one row for each regression that is introduced.

    It is detected by the first block while it is still there; any turn without it ends the search, with or without a change.
    """
    rows = rows.withColumn("_island", F.sum(F.when(F.col("role") == "introducing", 1).otherwise(0)).over(_ordered("condition"))).where("_island > 0")
    rows = rows.withColumn("_ended", F.sum(F.when(F.col("present"), 0).otherwise(1)).over(_ordered("condition", "_island")))
    out = rows.groupBy(*REPLICATION, "condition", "_island").agg(
        F.min(F.when(F.col("role") == "introducing", F.col("iteration"))).alias("introduced_at"),
        F.min(F.when((F.col("decision") == "BLOCK") & (F.col("_ended") == 0), F.col("iteration"))).alias("caught_at"),
    )
    return out.withColumn("delay", F.col("caught_at") - F.col("introduced_at")).drop("_island")


def survival_curve(rows: DataFrame) -> DataFrame:
    """(condition, iteration, surviving, running): replications keep their last state after their end.

    Instead of a grid of all iterations, each state is a step: +1 where a replication's state becomes surviving, -1 where
    it stops; running sums over the iterations give the curve, with one row for each change of state.
    """
    last = Window.partitionBy(*REPLICATION, "condition").orderBy("iteration")
    steps = rows.withColumn("_step", F.col("surviving").cast("int") - F.coalesce(F.lag(F.col("surviving").cast("int")).over(last), F.lit(0)))
    points = steps.groupBy("condition", "iteration").agg(F.sum("_step").alias("_step"), F.count("*").alias("running"))
    curve = Window.partitionBy("condition").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return points.select("condition", "iteration", F.sum("_step").over(curve).alias("surviving"), "running")


def before_state(records: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """Adds before: the state of the record in front, null for the first one."""
    return records.withColumn("before", F.lag(state).over(Window.partitionBy(*keys).orderBy(order)))
