"""Property-graph operators on DataFrames, for any number of graphs at once.

nodes: graph_id, id, owner, source, sink, sanitizer (booleans), digest; edges: graph_id, src, dst, kind (call, taint or
sanitize), via (array of makers). Closures are semi-naive: only the last round's new rows are joined with the edges, and
rows that are known already are taken out by an anti join. Every round is written to the shared folder, so lineage stays
short and a lost executor repeats one round.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Tables that ``settled`` wrote in this session, for ``clean``.
WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which all executors share; a temporary one where all is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="deltaloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, and read again; with ``by``, a folder for each value of that column, so that who
    wants one value reads nothing else."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def clean(spark: SparkSession) -> None:
    """Delete what ``settled`` wrote in this session; call it when the results have been consumed."""
    for path in WRITTEN:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    WRITTEN.clear()


def closure(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], rounds: int = 10_000) -> DataFrame:
    """``start`` and all that ``step`` adds to it, round by round, until nothing is new; one row for each key, the first
    found. A round writes its new rows only; what is known is the union of the rounds, put together after every eighth."""
    seen = frontier = settled(start)
    for i in range(1, rounds + 1):
        frontier = settled(step(frontier).join(seen.select(*keys), keys, "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if i % 8 == 0:
            seen = settled(seen)
    raise RuntimeError(f"the closure was not complete after {rounds} rounds")


def merged_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each (graph_id, src, dst, kind): makers united and sorted, the first resolution in order wins."""
    # makers are rows before they are collected, so that a set grows with distinct makers and not with parallel edges
    return edges.withColumn("maker", F.explode_outer("via")).groupBy("graph_id", "src", "dst", "kind").agg(
        F.array_sort(F.collect_set("maker")).alias("via"), F.min_by("resolution", order).alias("resolution")
    )


def taint_edges(nodes: DataFrame, edges: DataFrame, free: bool) -> DataFrame:
    """(graph_id, src, dst) of the taint edges, which may repeat; with ``free``, only those that touch no sanitizer."""
    flows = edges.where("kind = 'taint'").select("graph_id", "src", "dst")
    if free:
        guards = settled(nodes.where("sanitizer").select("graph_id", "id"))  # as small as it is, so that few guards are known to be few
        flows = flows.join(guards.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_anti").join(guards.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_anti")
    return flows.select("graph_id", "src", "dst")


def reachable(flows: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph_id, id): all that can be reached from ``starts``, themselves included where they have an edge."""
    ends = flows.select("graph_id", F.col("src").alias("id")).union(flows.select("graph_id", F.col("dst").alias("id"))).distinct()
    start = starts.select("graph_id", "id").distinct().join(ends, ["graph_id", "id"], "left_semi")
    return closure(start, lambda new: new.join(flows, (new["graph_id"] == flows["graph_id"]) & (new["id"] == flows["src"])).select(new["graph_id"], flows["dst"].alias("id")).distinct(), ["graph_id", "id"])


def in_blocks(marked: DataFrame) -> DataFrame:
    """(graph_id, id) -> graph_id, id, block, bit: 64 neighbours in the order of (graph_id, id) share a block."""
    placed = settled(marked.select("graph_id", "id").distinct().orderBy("graph_id", "id").select("graph_id", "id", F.monotonically_increasing_id().alias("_at")))
    return placed.select("graph_id", "id", F.shiftright("_at", 6).alias("block"), F.expr("shiftleft(1L, cast(_at % 64 AS int))").alias("bit"))


def numbered(ids: DataFrame) -> DataFrame:
    """(graph_id, id) -> graph_id, id, no: numbers in the order of (graph_id, id), so that neighbours have neighbouring ones."""
    return settled(ids.orderBy("graph_id", "id").select("graph_id", "id", F.monotonically_increasing_id().alias("no")))


def shortest_free_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, source, sink, path, hops): for every source and every other sink, the shortest path without a sanitizer,
    of several the one that is smallest as an array.

    Nodes are numbers in the order of their names. An edge is a bit: a row has a node and which ones of 64 neighbouring nodes
    (a part) it leads to. Sinks stand in blocks of 64, as bits too. Distances are found first, backwards from the sinks: a row of
    (node, block) has the bits of the sinks that are so far away. It meets the edges by its part, so what neighbours send to
    the same node is one row before anything is shuffled. From the sources on, the nodes on wanted paths choose for each
    sink the smallest next node that is one hop nearer, which at the last hop is the sink; then each pair follows those
    choices. No path is held that leads nowhere.
    """
    taint = edges.where("kind = 'taint'").select("graph_id", "src", "dst")
    guards = settled(nodes.where("sanitizer").select("graph_id", "id").distinct())
    ends = taint.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).where("graph_id IS NOT NULL AND id IS NOT NULL").distinct()
    names = numbered(ends.join(guards, ["graph_id", "id"], "left_anti"))
    part, bit = lambda c: F.shiftright(c, 6), lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 AS int))")
    known = lambda c, no: names.select("graph_id", F.col("id").alias(c), F.col("no").alias(no))
    links = taint.join(known("src", "a"), ["graph_id", "src"]).join(known("dst", "b"), ["graph_id", "dst"])
    links = settled(links.groupBy(part("b").alias("part"), F.col("a").alias("node")).agg(F.bit_or(bit("b")).alias("to")))
    there = lambda flag: nodes.where(flag).select("graph_id", "id").distinct().join(names, ["graph_id", "id"])
    sinks = settled(in_blocks(there("sink")).join(names, ["graph_id", "id"]).select("graph_id", F.col("id").alias("sink"), F.col("no").alias("sink_no"), "block", "bit"))
    key = ["node", "block"]
    seen = new = settled(sinks.groupBy(F.col("sink_no").alias("node"), "block").agg(F.bit_or("bit").alias("bits")))
    far, hops = new.limit(0).withColumn("hops", F.lit(0)), 0
    while True:
        hops += 1
        here = new.select(part("node").alias("part"), bit("node").alias("of"), "block", "bits")
        step = links.join(here, "part").where(F.col("to").bitwiseAND(F.col("of")) != 0).groupBy(*key).agg(F.bit_or("bits").alias("bits"))
        before = seen.select(*key, F.col("bits").alias("known"))
        new = settled(step.join(before, key, "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))).where("bits <> 0").select(*key, "bits"))
        if new.isEmpty():
            break
        far = far.union(new.withColumn("hops", F.lit(hops)))
        far = settled(far) if hops % 8 == 0 else far
        seen = settled(seen.union(new).groupBy(*key).agg(F.bit_or("bits").alias("bits")))
    far = settled(far)
    one = lambda rows: rows.join(sinks.select("block", "sink_no", "bit"), "block").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    # what is wanted of a node at a distance: at first the sources' own sinks, then those of the nodes that chose it
    sources = settled(there("source"))
    wanted = settled(far.join(sources.select(F.col("no").alias("node")), "node", "left_semi"))
    start = one(wanted).join(sources.select("graph_id", F.col("id").alias("source"), F.col("no").alias("node")), "node")
    start = settled(start.select("graph_id", "source", "sink_no", F.col("hops").alias("all"), "node", "hops", F.array("source").alias("path")))
    earlier = Window.partitionBy(*key).orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    chosen, asked = None, wanted.limit(0).drop("hops")
    for level in range(hops - 1, 1, -1):
        here = settled(wanted.where(F.col("hops") == level).select(*key, "bits").union(asked).groupBy(*key).agg(F.bit_or("bits").alias("bits")))
        if here.isEmpty():
            asked = here
            continue
        goal = far.where(F.col("hops") == level - 1).select(part("node").alias("part"), F.col("node").alias("next"), bit("node").alias("of"), "block", F.col("bits").alias("there"))
        # the nodes of a part that has an edge from here, of which the edge leads to some
        rows = links.join(here, "node").join(goal, ["part", "block"]).where(F.col("to").bitwiseAND(F.col("of")) != 0)
        rows = rows.withColumn("bits", F.col("bits").bitwiseAND(F.col("there"))).where("bits <> 0").select(*key, "next", "bits")
        taken = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("bits").over(earlier), F.lit(0).cast("long"))))
        picks = settled(rows.withColumn("bits", taken).where("bits <> 0").select(*key, F.lit(level).alias("hops"), "next", "bits"))
        chosen = picks if chosen is None else settled(chosen.union(picks)) if level % 8 == 0 else chosen.union(picks)
        asked = picks.select(F.col("next").alias("node"), "block", "bits")
    name = names.select(F.col("no").alias("next"), F.col("id").alias("step"))
    nexts = None if chosen is None else settled(one(chosen).select("node", "sink_no", "hops", "next").join(name, "next"))
    walk, done = start, None
    for _ in range(max(hops - 1, 1)):
        over = walk.where("hops = 1").join(sinks.select("sink_no", "sink"), "sink_no").select("graph_id", "source", "sink", F.array_append("path", F.col("sink")).alias("path"), F.col("all").alias("hops"))
        done = over if done is None else done.union(over)
        walk = walk.where("hops > 1")
        if nexts is None or walk.isEmpty():
            break
        walk = settled(walk.join(nexts, ["node", "sink_no", "hops"]).select("graph_id", "source", "sink_no", "all", F.col("next").alias("node"), (F.col("hops") - 1).alias("hops"), F.array_append("path", F.col("step")).alias("path")))
    return done


def symbols_on_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, symbol): owners of the nodes on a path from a source to a sink, and the makers of the edges between those."""
    flows = taint_edges(nodes, edges, free=False)  # read where they are: what a round finds is made distinct, not the edges
    back = flows.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    on = reachable(flows, nodes.where("source")).intersect(reachable(back, nodes.where("sink")))
    on = settled(on)
    owners = nodes.join(on, ["graph_id", "id"], "left_semi").select("graph_id", F.coalesce("owner", "id").alias("symbol"))
    taint = edges.where("kind = 'taint'")
    inner = taint.join(on.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(on.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi")
    # makers are distinct before the nodes join them, so that edges of neighbours are few rows
    return owners.union(inner.select("graph_id", F.explode("via").alias("symbol")).distinct()).distinct()


def guarded_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols on paths and the guards that they rely on: what they sanitize with, and what those call or sanitize with."""
    live = settled(symbols_on_paths(nodes, edges))
    sanitize = edges.where("kind = 'sanitize'").select("graph_id", F.col("src").alias("symbol"), F.col("dst").alias("next"))
    onward = edges.where("kind IN ('sanitize', 'call')").select("graph_id", F.col("src").alias("symbol"), F.col("dst").alias("next"))
    first = live.join(sanitize, ["graph_id", "symbol"]).select("graph_id", F.col("next").alias("symbol")).distinct().join(live, ["graph_id", "symbol"], "left_anti")
    guards = closure(first, lambda new: new.join(onward, ["graph_id", "symbol"]).select("graph_id", F.col("next").alias("symbol")).distinct().join(live, ["graph_id", "symbol"], "left_anti"), ["graph_id", "symbol"])
    return live.union(guards)


def changed_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id): symbols that were added or removed, or whose digest differs."""
    a, b = before.select("id", F.col("digest").alias("old"), F.lit(True).alias("was")), after.select("id", F.col("digest").alias("new"), F.lit(True).alias("is"))
    rows = a.join(b, "id", "full_outer")
    return rows.where("was IS NULL OR is IS NULL OR NOT (old <=> new)").select("id")


def owner_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v), both ways: owners that an edge ties; a taint edge with makers ties each maker to both ends, not the ends. A
    link comes once for each edge that makes it; ends are looked up only if some node has an owner beside itself."""
    tied = edges.select("graph_id", "kind", "via", "src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"))
    if not nodes.where("owner <> id").isEmpty():
        own = nodes.select("graph_id", "id", F.coalesce("owner", "id").alias("o"))
        tied = tied.drop("a", "b").join(own.select("graph_id", F.col("id").alias("src"), F.col("o").alias("a")), ["graph_id", "src"], "left").join(own.select("graph_id", F.col("id").alias("dst"), F.col("o").alias("b")), ["graph_id", "dst"], "left")
        tied = settled(tied.select("kind", "via", F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b")))
    made = (F.col("kind") == "taint") & (F.coalesce(F.size("via"), F.lit(0)) > 0)
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    a, b = F.col("a"), F.col("b")
    makers = F.flatten(F.transform("via", lambda m: F.array(pair(m, a), pair(a, m), pair(m, b), pair(b, m))))
    return tied.select(F.inline(F.when(made, makers).when(~made, F.array(pair(a, b), pair(b, a))))).where("u <> v")


def neighbourhoods(links: DataFrame, changed: DataFrame, owners: DataFrame, hops: int) -> list[DataFrame]:
    """(id) for every number of links from 0 to ``hops``: owners within so many links of a changed one. The next round looks up only
    what the last one has found, and none is done when nothing was found or nothing that is linked is left; then the last table
    stands for the rest. That is told by single ends, for which no link is shuffled."""
    seen = new = settled(changed.select("id").distinct().join(owners, "id", "left_semi"))
    out = [seen]
    if not hops:
        return out
    left = settled(links.select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti"))
    while len(out) <= hops:
        if new.isEmpty() or left.isEmpty():
            return out + [seen] * (hops + 1 - len(out))
        new = settled(links.join(new.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct().join(left, "id", "left_semi"))
        seen, left = seen if new.isEmpty() else seen.union(new), settled(left.join(new, "id", "left_anti"))
        out.append(seen)
    return out


def neighbourhood(links: DataFrame, changed: DataFrame, owners: DataFrame, hops: int) -> DataFrame:
    """(id): owners within ``hops`` links of a changed one."""
    return neighbourhoods(links, changed, owners, hops)[-1]


def restricted(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes whose owner is kept, and the edges between them."""
    inside = nodes.withColumn("_o", F.coalesce("owner", "id")).join(kept.select(F.col("id").alias("_o")), "_o", "left_semi").drop("_o")
    ids = inside.select("graph_id", "id")
    edges = edges.join(ids.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi")
    return inside, edges.select("graph_id", "src", "dst", "kind", "via")


def overlaid(base: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``change`` where it has the key, else those of ``base``."""
    return change.unionByName(base.join(change.select(*keys), keys, "left_anti"))


def without_symbols(symbols: DataFrame, gone: DataFrame, name: str = "qualname") -> DataFrame:
    """``symbols`` without those of ``gone`` and all that lies under them: every prefix of a dotted name is looked up."""
    parts = F.split(name, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    hit = symbols.select(name, F.explode(prefixes).alias("_p")).join(gone.select(F.col(name).alias("_p")), "_p", "left_semi").select(name).distinct()
    return symbols.join(hit, name, "left_anti")
