"""Views of the driver's tables in the shape that the operators read, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import turns as t
from ..operators.delta import Graph

POLICIES = [("A", None), ("B", 110.0), ("C", 60.0)]

TURNS = """
e AS (SELECT *, user_id // 3 AS trace_id, CAST(user_id % 3 AS INTEGER) AS seed,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS iteration FROM events),
b AS (SELECT trace_id, seed, iteration, value AS seconds, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens,
             CASE event_type WHEN 'signup' THEN 'matches-regressed' WHEN 'view' THEN 'matches-clean' WHEN 'error' THEN 'none' ELSE 'carried' END AS basis,
             CASE event_type WHEN 'error' THEN 'no-change' ELSE 'turn' END AS kind,
             CASE WHEN trace_id % 3 = 0 THEN 'local' ELSE 'cross_file' END AS scope,
             CASE trace_id % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'command' WHEN 2 THEN 'os-command' ELSE 'path-traversal' END AS vulnerability_class FROM e),
k AS (SELECT *, CASE basis WHEN 'matches-regressed' THEN scope || '_regression' WHEN 'matches-clean' THEN 'clean' END AS known FROM b),
l AS (SELECT *, CASE WHEN kind = 'turn' THEN coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY trace_id, seed ORDER BY iteration
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'clean') END AS label FROM k),
i AS (SELECT *, coalesce(coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY trace_id, seed ORDER BY iteration
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'clean') = 'clean' AND label <> 'clean', false) AS introduced FROM l),
r AS (SELECT *, CASE WHEN label IS NULL THEN 'no-change' WHEN label = 'clean' THEN 'clean' WHEN introduced THEN 'introducing' ELSE 'persisting' END AS role FROM i),
t AS (SELECT *, role IN ('introducing', 'persisting') AS present FROM r),
j AS (SELECT t.*, p.condition, CASE WHEN role = 'no-change' THEN NULL WHEN seconds > threshold THEN 'BLOCK' ELSE 'ALLOW' END AS decision
      FROM t, (VALUES ('A', NULL), ('B', 110.0), ('C', 60.0)) p(condition, threshold)),
c0 AS (SELECT *, sum(CASE WHEN role = 'clean' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, seed, condition ORDER BY iteration
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM j),
c1 AS (SELECT *, max(CASE WHEN decision = 'BLOCK' AND present THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, seed, condition, isl ORDER BY iteration
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS hit FROM c0),
q AS (SELECT *, present AND hit AS caught, present AND NOT hit AS surviving FROM c1),
d0 AS (SELECT *, sum(CASE WHEN role = 'introducing' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, seed, condition ORDER BY iteration
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS di FROM j),
d1 AS (SELECT *, sum(CASE WHEN present THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id, seed, condition, di ORDER BY iteration
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM d0 WHERE di > 0),
d AS (SELECT trace_id, seed, condition, min(iteration) FILTER (role = 'introducing') AS introduced_at,
             min(iteration) FILTER (decision = 'BLOCK' AND ended = 0) AS caught_at FROM d1 GROUP BY trace_id, seed, condition, di)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns: a user's events in order are a replication of a trace."""
    e = read(spark, sf_dir, "events")
    user = F.col("user_id")
    rows = e.select(
        F.floor(user / 3).cast("long").alias("trace_id"),
        (user % 3).cast("int").alias("seed"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("iteration"),
        F.col("value").alias("seconds"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        "event_type",
    )
    basis = F.when(F.col("event_type") == "signup", "matches-regressed").when(F.col("event_type") == "view", "matches-clean").when(F.col("event_type") == "error", "none").otherwise("carried")
    rows = rows.withColumn("basis", basis).withColumn("kind", F.when(F.col("event_type") == "error", "no-change").otherwise("turn")).drop("event_type")
    rows = rows.withColumn("scope", F.when(F.col("trace_id") % 3 == 0, "local").otherwise("cross_file"))
    names = F.array(*[F.lit(x) for x in ("sql", "command", "os-command", "path-traversal")])
    rows = rows.withColumn("vulnerability_class", F.get(names, (F.col("trace_id") % 4).cast("int")))
    known = F.when(F.col("basis") == "matches-regressed", F.concat("scope", F.lit("_regression"))).when(F.col("basis") == "matches-clean", "clean")
    return t.roles(t.carried_labels(rows.withColumn("known", known)))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.createDataFrame(POLICIES, "condition string, threshold double")
    return t.judged(turns(spark, sf_dir), policies, F.col("seconds"))


SPLIT = "1995-02-10"

EDGES = f"""
w AS (SELECT o.o_orderdate < TIMESTAMP '{SPLIT}' AS early, a.l_suppkey AS u, b.l_suppkey AS v, sum(a.l_quantity) AS weight,
             list_sort(list_distinct(list('s' || lpad(CAST(coalesce(p.l_suppkey, a.l_suppkey) AS VARCHAR), 6, '0')))) AS via
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_suppkey <> b.l_suppkey
      LEFT JOIN lineitem p ON p.l_orderkey = a.l_orderkey AND p.l_linenumber = a.l_linenumber - 1
      JOIN orders o ON o.o_orderkey = a.l_orderkey GROUP BY ALL),
edge AS (SELECT CASE WHEN early THEN 'before' ELSE 'after' END AS graph_id, 's' || lpad(CAST(u AS VARCHAR), 6, '0') AS src, 's' || lpad(CAST(v AS VARCHAR), 6, '0') AS dst, weight, via,
                CASE WHEN v % 10 = 3 THEN 'sanitize' ELSE 'taint' END AS kind FROM w),
ids AS (SELECT DISTINCT graph_id, src AS id FROM edge UNION SELECT DISTINCT graph_id, dst FROM edge),
node AS (SELECT i.graph_id, i.id, CAST(substr(i.id, 2) AS BIGINT) % 20 = 0 AS source, CAST(substr(i.id, 2) AS BIGINT) % 20 = 7 AS sink, CAST(substr(i.id, 2) AS BIGINT) % 10 = 3 AS sanitizer,
                coalesce(string_agg(e.dst || ':' || e.kind, ',' ORDER BY e.dst), '') AS digest
         FROM ids i LEFT JOIN edge e ON e.graph_id = i.graph_id AND e.src = i.id GROUP BY ALL)
"""


def supplier_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as symbols, before and after a date: an edge to each supplier that follows in an order, made by the one in
    front of both, or by the first. Suppliers whose number ends in 3 sanitize; 0 and 7 modulo 20 are sources and sinks.

    Lines are shuffled once, by their order; every line finds those of the next and the last number in its order's window. Pairs are
    shuffled once more, 64 neighbouring suppliers to a task, and written as one row for each supplier with its edges.
    """
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    there = lambda d: F.collect_list(F.struct("l_suppkey")).over(order.rangeBetween(d, d))
    lines = line.where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    pairs = lines.select("l_orderkey", "l_quantity", F.col("l_suppkey").alias("u"), there(1).alias("v"), there(-1).alias("maker"))
    pairs = pairs.select("*", F.explode("v.l_suppkey").alias("next")).where("u <> next").select("l_orderkey", "l_quantity", "u", F.col("next").alias("v"), F.explode_outer("maker.l_suppkey").alias("maker"))
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp")).alias("early"))
    name = lambda c: F.concat(F.lit("s"), F.lpad(F.col(c).cast("string"), 6, "0"))
    # an order without a date is after it, in an edge of its own
    rows = pairs.join(o, "l_orderkey").select(F.coalesce("early", F.lit(False)).alias("before"), "early", F.shiftright("u", 6).alias("near"), "u", "v", F.coalesce("maker", "u").alias("maker"), "l_quantity").repartition("before", "near")
    w = rows.groupBy("before", "near", "u", "v", "early").agg(F.sum("l_quantity").alias("weight"), F.array_sort(F.collect_set(name("maker"))).alias("via"))
    edge = F.struct(name("v").alias("dst"), F.when(F.col("v") % 10 == 3, "sanitize").otherwise("taint").alias("kind"), "weight", "via")
    out = w.groupBy("before", "near", "u").agg(F.array_sort(F.collect_list(edge)).alias("out"))
    digest = F.array_join(F.transform("out", lambda e: F.concat_ws(":", e["dst"], e["kind"])), ",")
    out = g.settled(out.select(F.when(F.col("before"), "before").otherwise("after").alias("graph_id"), name("u").alias("src"), digest.alias("digest"), "out"), "graph_id")
    edges = out.select("graph_id", "src", F.inline("out")).select("graph_id", "src", "dst", "weight", "via", "kind")
    own = out.select("graph_id", F.col("src").alias("id"), "digest")
    ends = edges.select("graph_id", F.col("dst").alias("id")).distinct().join(own.select("graph_id", "id"), ["graph_id", "id"], "left_anti")
    number = F.substring("id", 2, 9).cast("long")
    nodes = own.union(ends.withColumn("digest", F.lit("")))
    nodes = nodes.select("graph_id", "id", F.lit(None).cast("string").alias("owner"), (number % 20 == 0).alias("source"), (number % 20 == 7).alias("sink"), (number % 10 == 3).alias("sanitizer"), "digest")
    return g.settled(nodes, "graph_id"), edges


def sides(nodes: DataFrame, edges: DataFrame) -> tuple[Graph, Graph]:
    """The two graphs, each with one graph_id, so that rules compare them."""
    one = lambda df, side: df.where(F.col("graph_id") == side).withColumn("graph_id", F.lit("g"))
    return Graph(one(nodes, "before"), one(edges, "before")), Graph(one(nodes, "after"), one(edges, "after"))
