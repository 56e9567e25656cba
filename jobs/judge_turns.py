"""Judge recorded turns under decision policies and report how each policy does.

    python -m jobs.judge_turns --tables DIR --output DIR --config jobs/judge_turns.json

Reads ``events`` of the tables' folder as turns: labels carried forward, roles, a decision of every policy on every turn,
what it caught and what survives. Two tables come out, by condition:

- ``turns``: a row for each turn under each condition;
- ``summary``: the measures of a condition: recall on arrival, blocks of clean turns, detections, medians.

A run replaces the conditions that its configuration lists and leaves others, so policies can be added or judged again one
by one, and a run that is repeated gives the same. The summary is made from the turns as they were written.

Settings: ``policies``, a list of {"condition", "threshold"}, a null threshold never blocks; ``scopes``, those that count, all if empty.
Defined results: a condition listed twice is an error; a condition without turns has no rows; a replication without a turn
of a listed scope is left out as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators import measures as m
from deltaloom.operators import turns as t
from deltaloom.plans import adapters

from .common import checked, command_line, config, log, replaced

DEFAULTS = {"policies": [], "scopes": []}
TURNS = "trace_id long, seed int, iteration int, scope string, kind string, label string, basis string, role string, present boolean, seconds double, tokens long, decision string, caught boolean, surviving boolean, condition string"
SUMMARY = "introduced long, blocked long, clean_turns long, clean_blocked long, regressions long, detected long, on_arrival long, median_seconds double, surviving_turns long, condition string"


def policy_table(spark: SparkSession, policies: list[dict]) -> DataFrame:
    names = [p["condition"] for p in policies]
    if not names or len(set(names)) < len(names) or None in names:
        raise ValueError("policies must be listed, each condition once")
    return spark.createDataFrame([(p["condition"], None if p.get("threshold") is None else float(p["threshold"])) for p in policies], "condition string, threshold double")


def summary(turns: DataFrame) -> DataFrame:
    introducing = F.col("role") == "introducing"
    counts = turns.groupBy("condition").agg(
        m.count_where(introducing).alias("introduced"), m.count_where(introducing & (F.col("decision") == "BLOCK")).alias("blocked"), m.count_where(F.col("surviving")).alias("surviving_turns")
    )
    false = m.false_blocks(turns).select("condition", "clean_turns", "clean_blocked")
    found = m.detection_summary(t.detections(turns)).select("condition", "regressions", "detected", "on_arrival")
    medians = m.overhead(turns).select("condition", "median_seconds")
    out = counts.join(false, "condition", "left").join(found, "condition", "left").join(medians, "condition", "left")
    return out.fillna(0, ["regressions", "detected", "on_arrival"])


def run(spark: SparkSession, tables: str, output: str, settings: dict) -> DataFrame:
    """Judge all turns of ``tables`` under the listed policies; returns the whole output: turns with their condition's summary."""
    s, output = checked(settings, DEFAULTS), output.rstrip("/")
    policies = policy_table(spark, s["policies"])
    turns = adapters.turns(spark, tables)
    if s["scopes"]:
        turns = turns.where(F.col("scope").isin(*s["scopes"]))
    read, wrote = Observation("read"), Observation("wrote")
    turns = turns.observe(read, F.count("*").alias("n"))
    columns = [c.split()[0] for c in TURNS.split(", ")]
    rows = t.caught(t.judged(turns, policies, F.col("seconds"))).select(*columns).observe(wrote, F.count("*").alias("n"))
    replaced(rows, f"{output}/turns", "condition")
    log.info("read %d turns of %s, wrote %d rows to %s/turns", read.get["n"], tables, wrote.get["n"], output)
    listed = [p["condition"] for p in s["policies"]]
    judged = spark.read.schema(TURNS).parquet(f"{output}/turns").where(F.col("condition").isin(*listed))
    named = [c.split()[0] for c in SUMMARY.split(", ")]
    replaced(summary(judged).select(*named), f"{output}/summary", "condition")
    for r in spark.read.schema(SUMMARY).parquet(f"{output}/summary").where(F.col("condition").isin(*listed)).orderBy("condition").collect():
        log.info("wrote %s/summary: %s", output, r.asDict())
    return report(spark, output)


def report(spark: SparkSession, output: str) -> DataFrame:
    turns, totals = spark.read.schema(TURNS).parquet(f"{output}/turns"), spark.read.schema(SUMMARY).parquet(f"{output}/summary")
    return turns.join(totals, "condition")


def main() -> None:
    spark, args = command_line("judge_turns", "tables", "output")
    try:
        log.info("output: %d rows", run(spark, args.tables, args.output, config(spark, args.config)).count())
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
