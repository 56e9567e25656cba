"""Findings: differences of multisets that keep their rows, and items of findings in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled


def introduced(after: DataFrame, before: DataFrame, identity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``after`` beyond the number of equal findings in ``before``, the first ones in order being the known ones.

    Counts of ``before`` are pre-aggregated; a frequent identity is numbered in one task, but only its order columns.
    """
    known = before.groupBy(*identity).agg(F.count("*").alias("_known"))
    numbered = after.withColumn("_rn", F.row_number().over(Window.partitionBy(*identity).orderBy(*order)))
    rows = numbered.join(known, [numbered[c].eqNullSafe(known[c]) for c in identity], "left")
    return rows.where(F.col("_rn") > F.coalesce("_known", F.lit(0))).select(*[numbered[c] for c in after.columns])


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds number, from 1 in ``order``: ranges are sorted side by side, and only their sizes meet in one task."""
    placed = settled(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("number", (F.col("_before") + place + 1).cast("int")).drop("_part", "_before", "_at")


def items(findings: DataFrame, place: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """(place, number, findings): findings of one place as a sorted array, numbered in the order of the places."""
    grouped = findings.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct(*payload))).alias("findings"))
    return numbered(grouped, place).select(*place, "findings", "number")


def top_groups(flags: DataFrame, order: Sequence[str], member: str, groups: int = 8, members: int = 4) -> DataFrame:
    """The first ``groups`` groups in order, each with at most ``members`` of its members spelled out and the rest counted."""
    grouped = flags.groupBy(*order).agg(F.array_sort(F.collect_list(member)).alias("_all"))
    ranked = grouped.orderBy(*order).limit(groups)
    return ranked.select(*order, F.slice("_all", 1, members).alias("members"), F.greatest(F.lit(0), F.size("_all") - members).alias("more"))
