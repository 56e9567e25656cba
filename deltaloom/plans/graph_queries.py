"""Queries on the supplier graph before and after a date, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta, flows, graph
from .adapters import EDGES, read, sides, supplier_graph

W = f"WITH RECURSIVE {EDGES}"
SQL: dict[str, str] = {}

#: Taint edges off sanitizers, distances from every source over them, and the smallest of the shortest paths.
FREE = """
free AS (SELECT e.graph_id, e.src, e.dst FROM edge e WHERE kind = 'taint'
         AND NOT EXISTS (SELECT 1 FROM node n WHERE n.sanitizer AND n.graph_id = e.graph_id AND n.id IN (e.src, e.dst))),
fend AS (SELECT graph_id, src AS id FROM free UNION SELECT graph_id, dst FROM free),
fsrc AS (SELECT n.graph_id, n.id FROM node n JOIN fend USING (graph_id, id) WHERE n.source),
top AS (SELECT count(*) AS n FROM node),
walk AS (SELECT graph_id, id AS source, id AS node, 0 AS hops FROM fsrc
         UNION SELECT w.graph_id, w.source, f.dst, w.hops + 1 FROM walk w JOIN free f ON f.graph_id = w.graph_id AND f.src = w.node WHERE w.hops < (SELECT n FROM top)),
dist AS (SELECT graph_id, source, node, min(hops) AS hops FROM walk GROUP BY ALL),
paths AS (SELECT graph_id, source, node, [node] AS path, 0 AS hops FROM dist WHERE hops = 0
          UNION ALL SELECT p.graph_id, p.source, d.node, list_append(p.path, d.node), d.hops FROM paths p
          JOIN free f ON f.graph_id = p.graph_id AND f.src = p.node JOIN dist d ON d.graph_id = p.graph_id AND d.source = p.source AND d.node = f.dst AND d.hops = p.hops + 1),
sp AS (SELECT p.graph_id, p.source, p.node AS sink, min(p.path) AS path, min(p.hops) AS hops FROM paths p JOIN node n ON n.graph_id = p.graph_id AND n.id = p.node AND n.sink
       WHERE p.node <> p.source GROUP BY ALL)
"""
ON_PATHS = """
tnt AS (SELECT graph_id, src, dst FROM edge WHERE kind = 'taint'),
tend AS (SELECT graph_id, src AS id FROM tnt UNION SELECT graph_id, dst FROM tnt),
fwd AS (SELECT n.graph_id, n.id FROM node n JOIN tend USING (graph_id, id) WHERE n.source
        UNION SELECT f.graph_id, t.dst FROM fwd f JOIN tnt t ON t.graph_id = f.graph_id AND t.src = f.id),
bwd AS (SELECT n.graph_id, n.id FROM node n JOIN tend USING (graph_id, id) WHERE n.sink
        UNION SELECT f.graph_id, t.src FROM bwd f JOIN tnt t ON t.graph_id = f.graph_id AND t.dst = f.id),
onp AS (SELECT * FROM fwd INTERSECT SELECT * FROM bwd),
sym AS (SELECT graph_id, id AS symbol FROM onp UNION
        SELECT e.graph_id, unnest(e.via) FROM edge e JOIN onp a ON a.graph_id = e.graph_id AND a.id = e.src JOIN onp b ON b.graph_id = e.graph_id AND b.id = e.dst WHERE e.kind = 'taint')
"""
GUARDED = f"""{ON_PATHS},
grd AS (SELECT s.graph_id, e.dst AS symbol FROM sym s JOIN edge e ON e.graph_id = s.graph_id AND e.src = s.symbol AND e.kind = 'sanitize'
               WHERE NOT EXISTS (SELECT 1 FROM sym x WHERE x.graph_id = s.graph_id AND x.symbol = e.dst)
        UNION SELECT g.graph_id, e.dst FROM grd g JOIN edge e ON e.graph_id = g.graph_id AND e.src = g.symbol AND e.kind IN ('sanitize', 'call')
               WHERE NOT EXISTS (SELECT 1 FROM sym x WHERE x.graph_id = g.graph_id AND x.symbol = e.dst)),
gs AS (SELECT * FROM sym UNION SELECT * FROM grd)
"""
NEAR = """
chg AS (SELECT coalesce(a.id, b.id) AS id FROM (SELECT * FROM node WHERE graph_id = 'before') a FULL JOIN (SELECT * FROM node WHERE graph_id = 'after') b ON a.id = b.id
        WHERE a.id IS NULL OR b.id IS NULL OR a.digest <> b.digest),
mk AS (SELECT src, dst, unnest(via) AS m FROM edge WHERE kind = 'taint'),
tie0 AS (SELECT src AS u, dst AS v FROM edge WHERE kind <> 'taint' OR len(via) = 0 UNION SELECT m, src FROM mk UNION SELECT m, dst FROM mk),
tie AS (SELECT u, v FROM tie0 WHERE u <> v UNION SELECT v, u FROM tie0 WHERE u <> v),
nb0 AS (SELECT DISTINCT id FROM chg WHERE id IN (SELECT id FROM node)),
nb1 AS (SELECT id FROM nb0 UNION SELECT v FROM nb0 JOIN tie ON u = id),
nb2 AS (SELECT id FROM nb1 UNION SELECT v FROM nb1 JOIN tie ON u = id)
"""


def edge_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as parallel edges between suppliers, merged."""
    line, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    a = line.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("src"))
    b = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_suppkey").alias("dst"))
    rows = a.join(b, ["l_orderkey", "n"]).join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    rows = rows.select(F.lit("g").alias("graph_id"), "src", "dst", F.lit("taint").alias("kind"), F.array("o_orderpriority").alias("via"), F.col("o_orderstatus").alias("resolution"), F.struct("l_orderkey", "n").alias("ord"))
    return graph.merged_edges(rows, "ord").select("src", "dst", F.array_join("via", ",").alias("via"), "resolution")


SQL["edge_merge"] = """SELECT a.l_suppkey AS src, b.l_suppkey AS dst, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS via, arg_min(o_orderstatus, (a.l_orderkey, a.l_linenumber)) AS resolution
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN orders ON o_orderkey = a.l_orderkey GROUP BY 1, 2"""


def sanitizer_free_reachability(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = supplier_graph(spark, sf)
    return graph.reachable(graph.settled(graph.taint_edges(nodes, edges, free=True)), nodes.where("source"))


SQL["sanitizer_free_reachability"] = f"{W}, {FREE} SELECT DISTINCT graph_id, node AS id FROM dist"


def shortest_free_paths(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = supplier_graph(spark, sf)
    return graph.shortest_free_paths(nodes, edges).select("graph_id", "source", "sink", F.array_join("path", ">").alias("path"), F.col("hops").cast("long").alias("hops"))


SQL["shortest_free_paths"] = f"{W}, {FREE} SELECT graph_id, source, sink, array_to_string(path, '>') AS path, CAST(hops AS BIGINT) AS hops FROM sp"


def symbols_on_paths(spark: SparkSession, sf: str) -> DataFrame:
    return graph.symbols_on_paths(*supplier_graph(spark, sf))


SQL["symbols_on_paths"] = f"{W}, {ON_PATHS} SELECT * FROM sym"


def guarded_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return graph.guarded_symbols(*supplier_graph(spark, sf))


SQL["guarded_symbols"] = f"{W}, {GUARDED} SELECT * FROM gs"


def changed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    before, after = sides(*supplier_graph(spark, sf))
    return graph.changed_symbols(before.nodes, after.nodes)


SQL["changed_symbols"] = f"{W}, {NEAR} SELECT id FROM chg"


def neighbourhood_k2(spark: SparkSession, sf: str) -> DataFrame:
    before, after = sides(*supplier_graph(spark, sf))
    links = graph.owner_links(before.nodes, before.edges).union(graph.owner_links(after.nodes, after.edges))
    return graph.neighbourhood(links, graph.changed_symbols(before.nodes, after.nodes), before.nodes.union(after.nodes).select("id").distinct(), 2)


SQL["neighbourhood_k2"] = f"{W}, {NEAR} SELECT id FROM nb2"


def _flags(rows: DataFrame) -> DataFrame:
    return rows.select("rule", "a", "b", F.array_join("detail", ",").alias("detail"))


def _both(spark: SparkSession, sf: str, rule: str | None, hops: int | None) -> DataFrame:
    """The rule for the change and for its reverse, which is the control."""
    before, after = sides(*supplier_graph(spark, sf))
    rules = [rule] if rule else list(delta.RULES)
    before, after = delta.bounded(before, after, hops)  # the bound is the same both ways
    delta.solved([before, after], paths=rule in (None, "R2", "R4"), guards=rule in (None, "R3"))
    forward, back = _flags(delta.apply_rules(before, after, None, rules)), _flags(delta.apply_rules(after, before, None, rules))
    return forward.withColumn("change", F.lit("forward")).union(back.withColumn("change", F.lit("control")))


def rule_r1(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, "R1", None)


def rule_r2(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, "R2", None)


def rule_r3(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, "R3", None)


def rule_r4(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, "R4", None)


SIDES = "chs AS (SELECT * FROM (VALUES ('forward', 'before', 'after'), ('control', 'after', 'before')) x(change, old, new))"
RULES = {
    "R1": f"""{SIDES},
call AS (SELECT c.change, c.old, c.new, e.src AS caller, e.dst AS san FROM chs c JOIN edge e ON e.graph_id = c.old AND e.kind = 'sanitize'
         JOIN node n ON n.graph_id = c.old AND n.id = e.dst AND n.sanitizer JOIN node m ON m.graph_id = c.new AND m.id = e.src),
gone AS (SELECT change, san, list_sort(list_distinct(list(caller))) AS callers FROM call k WHERE NOT EXISTS (SELECT 1 FROM node n WHERE n.graph_id = k.new AND n.id = k.san AND n.sanitizer) GROUP BY ALL),
around AS (SELECT DISTINCT e.graph_id, unnest(e.via) AS caller, e.dst AS target FROM edge e JOIN node n ON n.graph_id = e.graph_id AND n.id = e.src AND NOT n.sanitizer WHERE e.kind = 'taint'),
fed AS (SELECT DISTINCT k.*, f.target FROM call k JOIN (SELECT graph_id, src, unnest(via) AS caller, dst AS target FROM edge WHERE kind = 'taint') f ON f.graph_id = k.old AND f.src = k.san AND f.caller = k.caller
        JOIN node n ON n.graph_id = k.new AND n.id = k.san AND n.sanitizer),
expo AS (SELECT change, san, caller, list_sort(list_distinct(list(target))) AS targets FROM fed f WHERE EXISTS (SELECT 1 FROM around a WHERE a.graph_id = f.new AND a.caller = f.caller AND a.target = f.target)
         AND NOT EXISTS (SELECT 1 FROM around a WHERE a.graph_id = f.old AND a.caller = f.caller AND a.target = f.target) GROUP BY ALL),
out AS (SELECT 'R1' AS rule, san AS a, CAST(NULL AS VARCHAR) AS b, array_to_string(callers, ',') AS detail, change FROM gone UNION ALL SELECT 'R1', san, caller, array_to_string(targets, ','), change FROM expo)""",
    "R2": f"""{FREE}, {SIDES},
out AS (SELECT 'R2' AS rule, n.source AS a, n.sink AS b, array_to_string(n.path, ',') AS detail, c.change FROM chs c JOIN sp n ON n.graph_id = c.new
        WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE o.graph_id = c.old AND o.source = n.source AND o.sink = n.sink))""",
    "R3": f"""{GUARDED}, {SIDES},
inboth AS (SELECT symbol FROM gs WHERE graph_id = 'before' INTERSECT SELECT symbol FROM gs WHERE graph_id = 'after'),
se AS (SELECT DISTINCT graph_id, src, dst FROM edge WHERE kind = 'sanitize'),
lost AS (SELECT c.*, e.src, e.dst FROM chs c JOIN se e ON e.graph_id = c.old JOIN inboth ON symbol = e.src WHERE NOT EXISTS (SELECT 1 FROM se x WHERE x.graph_id = c.new AND x.src = e.src AND x.dst = e.dst)),
added AS (SELECT c.change, e.src, list_sort(list_distinct(list(e.dst))) AS added FROM chs c JOIN se e ON e.graph_id = c.new WHERE NOT EXISTS (SELECT 1 FROM se x WHERE x.graph_id = c.old AND x.src = e.src AND x.dst = e.dst) GROUP BY ALL),
out AS (SELECT 'R3' AS rule, l.src AS a, l.dst AS b, coalesce(array_to_string(a.added, ','), '') AS detail, l.change FROM lost l LEFT JOIN added a ON a.change = l.change AND a.src = l.src)""",
    "R4": f"""{FREE}, {SIDES},
out AS (SELECT 'R4' AS rule, n.source AS a, n.sink AS b, o.hops || ',' || n.hops AS detail, c.change FROM chs c JOIN sp n ON n.graph_id = c.new
        JOIN sp o ON o.graph_id = c.old AND o.source = n.source AND o.sink = n.sink WHERE n.hops < o.hops)""",
}
for _name, _sql in RULES.items():
    SQL[f"rule_{_name.lower()}"] = f"{W}, {_sql} SELECT * FROM out"


def rules_all(spark: SparkSession, sf: str) -> DataFrame:
    """All rules within two hops of what changed, and without a bound for the control."""
    return _both(spark, sf, None, 2)


def ablation_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Flags by rule for the depths 0, 1, 2 and without a bound. Depths that share their graphs share paths, guards and flags."""
    before, after = sides(*supplier_graph(spark, sf))
    pairs = delta.bounded_by_depth(before, after, (0, 1, 2, None))
    different = list({id(pair): pair for pair in pairs.values()}.values())
    delta.solved([g for pair in different for g in pair])
    parts = [delta.apply_rules(*pair, None).groupBy("rule").agg(F.count("*").alias("flags")).select(F.explode(F.array(*[F.lit(-1 if h is None else h) for h in pairs if pairs[h] is pair])).alias("hops"), "rule", "flags") for pair in different]
    return reduce(DataFrame.union, parts)


def rule_tally_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _both(spark, sf, None, None).rollup("change", "rule").agg(F.count("*").alias("flags"))
    return rows.where("flags > 0")


SQL["rule_tally_rollup"] = (
    f"{W}, {FREE}, {GUARDED}, "
    + RULES["R1"].replace("out AS", "o1 AS") + ", " + RULES["R2"].split(f"{SIDES},")[1].replace("out AS", "o2 AS") + ", "
    + RULES["R3"].split(f"{SIDES},")[1].replace("out AS", "o3 AS") + ", " + RULES["R4"].split(f"{SIDES},")[1].replace("out AS", "o4 AS")
    + ", out AS (SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM o3 UNION ALL SELECT * FROM o4) SELECT change, rule, count(*) AS flags FROM out GROUP BY ROLLUP (change, rule) HAVING count(*) > 0"
)


def graph_statistics(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = supplier_graph(spark, sf)
    kinds = edges.groupBy("graph_id", F.col("kind").alias("what")).agg(F.count("*").alias("n"))
    roles = nodes.select("graph_id", F.explode(F.array(*[F.when(F.col(c), c) for c in ("source", "sink", "sanitizer")])).alias("what")).where("what IS NOT NULL")
    return kinds.union(roles.groupBy("graph_id", "what").agg(F.count("*").alias("n")))


SQL["graph_statistics"] = f"""{W} SELECT graph_id, kind AS what, count(*) AS n FROM edge GROUP BY ALL UNION ALL SELECT graph_id, 'source', count(*) FROM node WHERE source GROUP BY ALL
UNION ALL SELECT graph_id, 'sink', count(*) FROM node WHERE sink GROUP BY ALL UNION ALL SELECT graph_id, 'sanitizer', count(*) FROM node WHERE sanitizer GROUP BY ALL"""

def supporting_paths(spark: SparkSession, sf: str) -> DataFrame:
    """For every supplier before the date, a path from a source to a sink through it or through one that it serves."""
    before, _ = sides(*supplier_graph(spark, sf))
    rows = flows.supporting_paths(before.nodes, before.edges, before.nodes.select(F.col("id").alias("symbol")))
    return rows.select("symbol", F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("length"))


QUERIES = {f.__name__: f for f in (
    edge_merge, sanitizer_free_reachability, shortest_free_paths, symbols_on_paths, guarded_symbols, changed_symbols, neighbourhood_k2, rule_r1, rule_r2, rule_r3, rule_r4, rules_all,
    ablation_by_depth, rule_tally_rollup, graph_statistics, supporting_paths)}
