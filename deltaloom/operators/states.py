"""Snapshots, caches and funnels: full outer comparisons, upserts by key, first-wins de-duplication, skip reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, old, new, change): added, removed or modified rows of two states."""
    a, b = before.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_was")), after.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_is"))
    rows = a.join(b, list(keys), "full_outer")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return rows.withColumn("change", change).where("change IS NOT NULL").drop("_was", "_is")


def applied(state: DataFrame, change: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``state`` with the rows of ``change`` in the place of those with the same keys; nothing is removed."""
    return change.select(*state.columns).unionByName(state.join(change.select(*keys), list(keys), "left_anti"))


def upserted(store: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The latest row for each key of both tables; of one table's rows for a key, the last by ``order`` is the latest."""
    both = store.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "_new")


def hits_and_misses(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cached rows of what is wanted, and the keys that have to be computed, once each."""
    once = wanted.select(*keys).distinct()
    return wanted.join(cache, list(keys)), once.join(cache.select(*keys), list(keys), "left_anti")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row for each key; rows without a key all stay."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_rn", F.when(F.col(key).isNull(), 1).otherwise(rn)).where("_rn = 1").drop("_rn")


def funnel(rows: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the first test that holds, or 'kept'."""
    out = F
    for name, test in reasons:
        out = out.when(test, F.lit(name))
    return rows.withColumn("reason", out.otherwise("kept"))


def within_budget(blocks: DataFrame, keys: Sequence[str], order: str, size: Column, budget: int) -> DataFrame:
    """Adds cut: how much of each block fits while a running sum stays under the budget."""
    run = F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("cut", F.greatest(F.lit(0), F.least(size, F.lit(budget) - (run - size))))


def are_prefixes(rows: DataFrame, group: str, member: str, order: str, value: str) -> DataFrame:
    """(group, members, is_prefix): is every member's ordered list a prefix of the longest one of its group?"""
    lists = rows.groupBy(group, member).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))
    longest = lists.groupBy(group).agg(F.max_by("v", F.struct(F.size("v"), F.col(member))).alias("top"))
    same = F.slice("top", 1, F.size("v")) == F.col("v")
    return lists.join(longest, group).groupBy(group).agg(F.count("*").alias("members"), F.every(same).alias("is_prefix"))


def shown_blocks(blocks: DataFrame, keys: Sequence[str], order: str, text: str, budget: int) -> DataFrame:
    """``blocks`` that are shown within a budget of characters, with shown (text) and hidden (blocks left out behind it).

    Blocks are whole while they fit; the first that doesn't is cut at a line end, and nothing after it is shown. ``hidden`` is
    null but for the cut one.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    size = F.length(text)
    rows = blocks.withColumn("_left", F.lit(budget) - (F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)) - size))
    rows = rows.withColumn("_over", size > F.col("_left")).withColumn("_cuts", F.sum(F.col("_over").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_rest", F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(by))
    head = F.substring(F.col(text), F.lit(1), F.greatest(F.col("_left"), F.lit(0)))
    at_line = F.when(head.contains("\n"), F.regexp_replace(head, r"(?s)\n[^\n]*\z", "")).otherwise(head)
    rows = rows.where((F.col("_cuts") == 0) | ((F.col("_cuts") == 1) & F.col("_over")))
    return rows.withColumn("shown", F.when(F.col("_over"), at_line).otherwise(F.col(text))).withColumn("hidden", F.when(F.col("_over"), F.col("_rest")).cast("long")).drop("_left", "_over", "_cuts", "_rest")


def running_totals(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows in front of each, by ``order``, which must be unique. No task sees all rows:
    ranges of the order are summed first, and only their totals meet."""
    from .graph import settled

    ranged = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))  # a row for each range
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(before, "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def admitted(requests: DataFrame, group: str, key: str, budget: int, cached: DataFrame | None = None) -> DataFrame:
    """(group, requests, calls, before, admitted): which groups run, in their order, on a budget of calls.

    A request whose key was met by an earlier group, earlier in its own, or is ``cached`` (key) makes no call. A group runs if
    fewer than ``budget`` calls were made in front of it, and then as a whole, so the last one may go over. Null groups are none.
    """
    rows = requests.where(F.col(group).isNotNull())
    first = rows.groupBy(key).agg(F.min(group).alias(group))
    if cached is not None:
        first = first.join(cached.select(key).distinct(), key, "left_anti")
    calls = first.groupBy(group).agg(F.count("*").alias("calls"))
    groups = rows.groupBy(group).agg(F.count("*").alias("requests")).join(calls, group, "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    return running_totals(groups, [group], "calls", "before").select(group, "requests", "calls", "before", (F.col("before") < budget).alias("admitted"))


def stopped(groups: DataFrame) -> DataFrame:
    """(complete, ran, calls, next): one row that says whether all groups of ``admitted`` ran, and before which one it stopped."""
    group = groups.columns[0]
    ran = F.col("admitted")
    return groups.agg(F.every("admitted").alias("complete"), F.count(F.when(ran, 1)).alias("ran"), F.sum(F.when(ran, F.col("calls"))).alias("calls"), F.min(F.when(~ran, F.col(group))).alias("next"))
