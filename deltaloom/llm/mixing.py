"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue whose documents stand in a fixed pseudo-random order and are served in up to ``max_epochs``
passes. A copy of a document finishes at the virtual time ``words its source has served by then / target of its source``;
serving all queues at rates proportional to their targets is then the global order of those finish times, and the mix is
that order cut at the total budget. A copy that its source's target cuts is served in part.

Hot sources: the order within a source comes from a hash, so a leading slice of the hash range is a bucket of bounded
share. Running sums are taken inside a bucket and offset by the totals of the buckets before it, which are small tables;
the global order is cut into slices of virtual time in the same way. The buckets only spread the work: results don't
depend on their number.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a null doc_id hashes as the
empty string; documents of one source and key, which are rows that repeat, are ordered by id and size; rows that repeat in
full are separate documents with the same row in the result; copies of equal finish times are ordered by source, then key; a
text of any length is one document, of which a copy may be cut; other columns are ignored in ``mixed_sizes`` and unchanged in
``mixed_documents``, whatever their names; an empty table gives an empty result. Reruns agree, since nothing depends on the
order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size) -> the same rows with ``target``.

    Sources by code point, nulls last, take the weights in turn. Their targets add up to ``share`` times all words; none
    is above ``max_epochs`` times its source, and what is over is shared again by weight. That ends at the level L where
    the targets ``least(cap, L * weight)`` add up: the sources in order of cap / weight are capped up to the first that
    stays under the level of those that are left.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sizes.select("source", "source_size", F.get(cycle, ((rank - 1) % len(weights)).cast("int")).alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.select(
        "*",
        (F.sum("source_size").over(every) * float(share)).alias("budget"),
        F.sum("w").over(every).alias("all_w"),
        (F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("cap_before"),
        (F.sum("w").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).alias("w_before"),
    )
    level = (F.col("budget") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    rows = rows.withColumn("level", level)
    # taking out a source that is over its cap raises the level for the rest, taking out any other one lowers it
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("w")))
    return rows.select("source", "source_size", "target", F.floor(F.sum("target").over(every)).cast("long").alias("total_budget"))


def mix(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """One row for each copy that the mix serves or could serve.

    ``keep``: columns of ``docs`` to carry. Columns: those, source, size, source_size, target, key, copy (from 0),
    served (words of this copy that its source's target lets through), virtual_finish, mix_start (words of the mix before
    it) and taken (words after the cut at the total budget); (source, slice, place) identifies the document.
    """
    spark = docs.sparkSession
    buckets = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the text is in the key, so that rows that share an id, or have none, are spread as well
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)])
    slice_ = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")
    rows = rows.withColumn("slice", slice_)
    totals = rows.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    before = totals.select(
        "source",
        "slice",
        (F.sum("in_slice").over(Window.partitionBy("source").orderBy("slice")) - F.col("in_slice")).alias("offset"),
    )
    goal = targets(totals.groupBy("source").agg(F.sum("in_slice").alias("source_size")), weights, share, max_epochs)
    before = before.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(F.col("b.source").alias("b_source"), F.col("slice").alias("b_slice"), "offset", "source_size", "target", "total_budget")
    order = Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("slice") == F.col("b_slice")))
    # the copies of a document finish one pass of its source apart
    rows = rows.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(max_epochs)])))
    ends = F.col("offset") + F.col("inside") + F.col("copy") * F.col("source_size")
    rows = rows.withColumn("ends", ends).withColumn("served", F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), F.floor(F.col("target")) - (F.col("ends") - F.col("size")))).cast("long"))
    finish = F.when(F.col("target") > 0, F.least(F.col("ends").cast("double"), F.col("target")) / F.col("target")).otherwise(0.0)
    rows = rows.withColumn("virtual_finish", finish)
    # global order: finish times are spread evenly over [0, 1], so equal slices of virtual time are even ranges
    # (copies that aren't served stand outside the order; they are spread by their hash)
    rows = rows.withColumn("span", F.when(F.col("served") > 0, F.least(F.lit(buckets - 1), (F.col("virtual_finish") * buckets).cast("int"))).otherwise(F.col("slice")))
    spans = rows.groupBy("span").agg(F.sum("served").alias("in_span"))
    everything = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.select(F.col("span").alias("s_span"), (F.sum("in_span").over(everything) - F.col("in_span")).alias("span_start"))
    in_span = Window.partitionBy("span").orderBy("virtual_finish", F.col("source").asc_nulls_last(), "key", F.col("doc_id").asc_nulls_last(), "place", "copy")
    rows = rows.withColumn("run", F.sum("served").over(in_span.rowsBetween(Window.unboundedPreceding, 0)) - F.col("served"))
    rows = rows.join(F.broadcast(spans), F.col("span") == F.col("s_span"))  # as many rows as slices
    rows = rows.withColumn("mix_start", F.col("span_start") + F.col("run"))
    taken = F.greatest(F.lit(0), F.least(F.col("served"), F.col("total_budget") - F.col("mix_start"))).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", "key", "slice", "place", "copy", "served", "virtual_finish", "mix_start", taken.alias("taken"), *[F.col(f"_keep_{i}").alias(f"keep_{c}") for i, c in enumerate(keep)])


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each row of ``docs``."""
    rows = mix(docs, **options)
    return rows.groupBy("source", "slice", "place").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken")
    ).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix serves them, whole: a copy that its target cuts is in if more than half
    of it is. Other columns are carried unchanged.

    The mix is of narrow rows; texts are shuffled once, to meet the number of copies of their row. Rows that are equal in
    all columns are interchangeable, so one of them stands for the copies of all.
    """
    plain = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    same = F.xxhash64(*plain, *[c.isNull() for c in plain])
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("of"), same.alias("hash"))
    served = mix(rows, keep=["of", "hash"], **options).where((F.col("taken") > 0) & (F.col("taken") * 2 > F.col("size")))
    copies = served.groupBy(F.col("keep_of").alias("of"), F.col("keep_hash").alias("hash")).agg(F.count("*").alias("copies"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows.select("row", "of", "hash").repartition(parts, "of", "hash").dropDuplicates(["of", "hash"])
    return once.join(copies, ["of", "hash"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS w,
             2 * source_size AS cap FROM s),
c AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS budget, sum(w) OVER () AS all_w,
             CAST(sum(cap) OVER o AS BIGINT) - cap AS cap_before, sum(w) OVER o - w AS w_before
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, (budget - cap_before) / (all_w - w_before) AS level FROM c),
g AS (SELECT source, source_size,
             least(CAST(cap AS DOUBLE), max(level) OVER () * w) AS target FROM l),
q AS (SELECT d.*, g.source_size, g.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS inside,
             row_number() OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size) AS place
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, inside + e.copy * source_size AS ends FROM q, (VALUES (0), (1)) e(copy)),
v AS (SELECT *, CAST(greatest(0, least(size, floor(target) - (ends - size))) AS BIGINT) AS served,
             CASE WHEN target > 0 THEN least(CAST(ends AS DOUBLE), target) / target ELSE 0 END AS finish FROM k),
m AS (SELECT *, CAST(sum(served) OVER (ORDER BY finish, source NULLS LAST, key, doc_id NULLS LAST, place, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - served AS mix_start,
             (SELECT CAST(floor(sum(target)) AS BIGINT) FROM g) AS total_budget FROM v)
SELECT doc_id, source, size, source_size, target, CAST(sum(greatest(0, least(served, total_budget - mix_start))) AS BIGINT) AS taken
FROM m GROUP BY doc_id, source, size, source_size, target, place
"""
