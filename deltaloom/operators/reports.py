"""Reports on a data set of events: which advisories make one event, what is excluded from retrieval, how traces ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import event_id, is_leakage_test


def grouped_events(advisories: DataFrame, lowest: int | None = None, highest: int | None = None) -> DataFrame:
    """(repo, fix, vulnerable, advisory, lines) -> one event for each (repo, fix, vulnerable): its sorted distinct advisories,
    and its id by the first of them. With bounds, only advisories whose number of lines is within them."""
    rows = advisories
    if lowest is not None:
        rows = rows.where(F.col("lines") >= lowest)
    if highest is not None:
        rows = rows.where(F.col("lines") <= highest)
    out = rows.where("vulnerable IS NOT NULL").groupBy("repo", "fix", "vulnerable").agg(F.array_sort(F.collect_set("advisory")).alias("advisories"))
    return out.withColumn("event_id", event_id(F.col("repo"), F.col("advisories")[0]))


def by_repository(linked: DataFrame, unlinked: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, advisories, fixes): of every repository in ``repos`` (repo, alias) the advisories under its alias, or its own name
    without one; those with a fix and those that name none. ``linked``: repo, advisory, fix; ``unlinked``: repo, advisory."""
    named = repos.select("repo", F.coalesce("alias", "repo").alias("source"))
    every = linked.select("repo", "advisory", "fix").unionByName(unlinked.select("repo", "advisory", F.lit(None).cast("string").alias("fix")))
    found = every.groupBy(F.col("repo").alias("source")).agg(F.countDistinct("advisory").alias("advisories"), F.countDistinct("fix").alias("fixes"))
    none = F.lit(0).cast("long")
    return named.join(found, "source", "left").select("repo", F.coalesce("advisories", none).alias("advisories"), F.coalesce("fixes", none).alias("fixes"))


def exclusions(fix_files: DataFrame, near: DataFrame) -> DataFrame:
    """(event_id, path, symbol, reason): whole test files that a fix changes, and near copies of its code anywhere else.

    ``fix_files``: event_id, path; ``near``: event_id, path, symbol, which may repeat.
    """
    whole = fix_files.where(is_leakage_test(F.col("path"))).select("event_id", "path").distinct()
    copies = near.select("event_id", "path", "symbol").distinct().join(whole, ["event_id", "path"], "left_anti")
    files = whole.select("event_id", "path", F.lit(None).cast("string").alias("symbol"), F.lit("fix-test").alias("reason"))
    return files.union(copies.select("event_id", "path", "symbol", F.lit("near-duplicate").alias("reason")))


def leakage_totals(fix_files: DataFrame, near: DataFrame) -> DataFrame:
    """One row: events, those with exclusions and with near copies, and how many there are of each."""
    out = exclusions(fix_files, near)
    files = fix_files.select("event_id", "path").distinct()
    test = is_leakage_test(F.col("path"))
    counts = files.agg(F.countDistinct("event_id").alias("events"), F.count(F.when(test, 1)).alias("fix_tests_excluded"), F.count(F.when(~test, 1)).alias("fix_sources_left_in_scope"))
    listed = out.agg(F.countDistinct("event_id").alias("events_with_exclusions"), F.count("*").alias("exclusions"))
    copies = near.agg(F.countDistinct("event_id").alias("events_with_near_duplicates"), F.countDistinct("event_id", "path", "symbol").alias("near_duplicates"))
    return counts.join(listed).join(copies)  # one row each


def trace_summaries(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(trace_id, seed, turns, ended, billed, injection, as_planned): how every replication of a recorded trace ended.

    ``rows``: trace_id, seed, iteration, kind ('turn', or what ended it), tokens, cached, injected; ``plans``: trace_id,
    planned_turns, injection_turn. Tokens of cached replies aren't billed.
    """
    turn = F.col("kind") == "turn"
    out = rows.groupBy("trace_id", "seed").agg(
        F.coalesce(F.max(F.when(turn, F.col("iteration"))), F.lit(0)).alias("turns"),
        F.max_by("kind", "iteration").alias("last"),
        F.coalesce(F.sum(F.when(~F.col("cached"), F.col("tokens"))), F.lit(0)).cast("long").alias("billed"),
        F.min(F.when(F.col("injected"), F.col("iteration"))).alias("injected_at"),
    )
    ended = F.when(F.col("last") != "turn", F.col("last")).when(F.col("turns") >= F.col("planned_turns"), "complete").otherwise("incomplete")
    injection = F.when(F.col("injected_at").isNull(), "not-reached").when(F.col("injected_at") == F.col("injection_turn"), "as-planned").otherwise("elsewhere")
    return out.join(plans, "trace_id").select("trace_id", "seed", "turns", ended.alias("ended"), "billed", injection.alias("injection"))


def largest(rows: DataFrame, group: str, test: Column, most: int = 10) -> DataFrame:
    """(group, n): the ``most`` groups with the most rows that meet ``test``, ties by name."""
    return rows.where(test).groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(most)


def label_tally(turns: DataFrame) -> DataFrame:
    """(iteration, label, n, carried): labels by turn, and how many of them were carried forward."""
    return turns.where("label IS NOT NULL").groupBy("iteration", "label").agg(F.count("*").alias("n"), F.count(F.when(F.col("basis") == "carried", 1)).alias("carried"))


def occurrences(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds occurrence: 0 for the first row of a key, 1 for the next, and so on."""
    return rows.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
