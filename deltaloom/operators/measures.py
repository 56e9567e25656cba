"""Measures of the judged turns. Shares keep their integer parts, so nothing depends on rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def count_where(test: Column) -> Column:
    return F.count(F.when(test, 1))


def recall_at_introduction(rows: DataFrame) -> DataFrame:
    """Of the turns that introduce a regression, how many were blocked: by condition, and by scope and class in it."""
    introducing = rows.where("role = 'introducing'")
    grouped = introducing.groupingSets([["condition"], ["condition", "scope"], ["condition", "vulnerability_class"]], "condition", "scope", "vulnerability_class")
    out = grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("introduced"), count_where(F.col("decision") == "BLOCK").alias("blocked"))
    return out.withColumn("recall", share(F.col("blocked"), F.col("introduced")))


def false_blocks(rows: DataFrame) -> DataFrame:
    """Readings of blocks on turns without a new regression, and the precision of blocks."""
    clean, block = F.col("role") == "clean", F.col("decision") == "BLOCK"
    out = rows.groupBy("condition").agg(
        count_where(clean).alias("clean_turns"),
        count_where(clean & block).alias("clean_blocked"),
        count_where(clean & (F.col("basis") != "carried")).alias("clean_not_carried"),
        count_where(clean & (F.col("basis") != "carried") & block).alias("clean_not_carried_blocked"),
        count_where(F.col("role").isin("clean", "persisting")).alias("not_new"),
        count_where(F.col("role").isin("clean", "persisting") & block).alias("not_new_blocked"),
        count_where(block).alias("blocks"),
        count_where(block & F.col("present")).alias("true_blocks"),
    )
    return out.withColumn("precision", share(F.col("true_blocks"), F.col("blocks"))).withColumn("clean_share", share(F.col("clean_blocked"), F.col("clean_turns")))


def overhead(rows: DataFrame) -> DataFrame:
    """Exact medians and means of what a policy adds to a turn; untimed rows don't count."""
    return rows.where("decision IS NOT NULL").groupBy("condition").agg(
        F.median("seconds").alias("median_seconds"), F.avg("tokens").alias("mean_tokens"), F.count("seconds").alias("timed"), F.sum("tokens").alias("tokens")
    )


def full_overhead(rows: DataFrame) -> DataFrame:
    """What a policy adds, over judged rows of (condition, scan_seconds, graph_seconds, triage_ms, model_call, input_tokens,
    output_tokens): medians of each part over the rows that have it, of their sum over the rows with a timed scan, and means of
    tokens over calls, to one digit."""
    call, timed = F.col("model_call"), F.col("scan_seconds").isNotNull()
    added = F.col("scan_seconds") + F.coalesce("graph_seconds", F.lit(0.0)) + F.coalesce("triage_ms", F.lit(0)) / 1000
    return rows.groupBy("condition").agg(
        F.median("graph_seconds").alias("median_graph_seconds"),
        F.median(F.when(call, F.col("triage_ms") / 1000)).alias("median_triage_seconds"),
        F.median("scan_seconds").alias("median_scan_seconds"),
        F.median(added).alias("median_added_seconds"),
        count_where(timed).alias("timed"),
        count_where(call).alias("model_calls"),
        F.round(F.avg(F.when(call, F.col("input_tokens"))), 1).alias("mean_input_tokens"),
        F.round(F.avg(F.when(call, F.col("output_tokens"))), 1).alias("mean_output_tokens"),
    )


def inventory(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.countDistinct("trace_id").alias("traces"),
        F.countDistinct("trace_id", "seed").alias("replications"),
        F.count("*").alias("turns"),
        *[count_where(F.col("role") == r).alias(r.replace("-", "_")) for r in ("clean", "introducing", "persisting", "no-change")],
    )


def detection_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("condition").agg(
        F.count("*").alias("regressions"), F.count("caught_at").alias("detected"), count_where(F.col("delay") == 0).alias("on_arrival"), F.avg("delay").alias("mean_delay")
    )
