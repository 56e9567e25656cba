"""Queries on judged turns and findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as fi
from ..operators import measures as m
from ..operators import states as st
from ..operators import stats, turns
from .adapters import TURNS, judged, read
from .adapters import turns as turn_rows

W = f"WITH {TURNS}"
SQL: dict[str, str] = {}


def recall_at_introduction(spark: SparkSession, sf: str) -> DataFrame:
    return m.recall_at_introduction(judged(spark, sf)).select("condition", "scope", "vulnerability_class", "introduced", "blocked", "recall")


SQL["recall_at_introduction"] = f"""{W}
SELECT condition, scope, vulnerability_class, count(*) AS introduced, count(*) FILTER (decision = 'BLOCK') AS blocked,
       count(*) FILTER (decision = 'BLOCK') / count(*) AS recall
FROM j WHERE role = 'introducing' GROUP BY GROUPING SETS ((condition), (condition, scope), (condition, vulnerability_class))"""


def turn_labels_locf(spark: SparkSession, sf: str) -> DataFrame:
    return turn_rows(spark, sf).select("trace_id", "seed", "iteration", "basis", "label", "introduced", "role")


SQL["turn_labels_locf"] = f"{W} SELECT trace_id, seed, iteration, basis, label, introduced, role FROM t"


def caught_surviving(spark: SparkSession, sf: str) -> DataFrame:
    return turns.caught(judged(spark, sf)).select("trace_id", "seed", "condition", "iteration", "decision", "caught", "surviving")


SQL["caught_surviving"] = f"{W} SELECT trace_id, seed, condition, iteration, decision, caught, surviving FROM q"


def detection_delay(spark: SparkSession, sf: str) -> DataFrame:
    return turns.detections(judged(spark, sf))


SQL["detection_delay"] = f"{W} SELECT trace_id, seed, condition, introduced_at, caught_at, caught_at - introduced_at AS delay FROM d"


def detection_summary(spark: SparkSession, sf: str) -> DataFrame:
    return m.detection_summary(turns.detections(judged(spark, sf)))


SQL["detection_summary"] = f"""{W} SELECT condition, count(*) AS regressions, count(caught_at) AS detected,
count(*) FILTER (caught_at = introduced_at) AS on_arrival, avg(caught_at - introduced_at) AS mean_delay FROM d GROUP BY condition"""


def degradation_curve(spark: SparkSession, sf: str) -> DataFrame:
    return turns.survival_curve(turns.caught(judged(spark, sf)))


SQL["degradation_curve"] = f"""{W},
rep AS (SELECT trace_id, seed, condition, max(iteration) AS ends, max_by(surviving, iteration) AS final FROM q GROUP BY ALL),
ended AS (SELECT condition, ends, count(*) FILTER (final) AS n FROM rep GROUP BY ALL),
live AS (SELECT condition, iteration, count(*) FILTER (surviving) AS s, count(*) AS running FROM q GROUP BY ALL)
SELECT l.condition, l.iteration, CAST(l.s + coalesce((SELECT sum(n) FROM ended x WHERE x.condition = l.condition AND x.ends < l.iteration), 0) AS BIGINT) AS surviving, l.running FROM live l"""


def false_block_readings(spark: SparkSession, sf: str) -> DataFrame:
    return m.false_blocks(judged(spark, sf))


SQL["false_block_readings"] = f"""{W},
n AS (SELECT condition, count(*) FILTER (role = 'clean') AS clean_turns, count(*) FILTER (role = 'clean' AND decision = 'BLOCK') AS clean_blocked,
 count(*) FILTER (role = 'clean' AND basis <> 'carried') AS clean_not_carried, count(*) FILTER (role = 'clean' AND basis <> 'carried' AND decision = 'BLOCK') AS clean_not_carried_blocked,
 count(*) FILTER (role IN ('clean', 'persisting')) AS not_new, count(*) FILTER (role IN ('clean', 'persisting') AND decision = 'BLOCK') AS not_new_blocked,
 count(*) FILTER (decision = 'BLOCK') AS blocks, count(*) FILTER (decision = 'BLOCK' AND present) AS true_blocks FROM j GROUP BY condition)
SELECT *, CASE WHEN blocks > 0 THEN true_blocks / blocks END AS precision, CASE WHEN clean_turns > 0 THEN clean_blocked / clean_turns END AS clean_share FROM n"""


def overhead_medians(spark: SparkSession, sf: str) -> DataFrame:
    return m.overhead(judged(spark, sf))


SQL["overhead_medians"] = f"""{W} SELECT condition, median(seconds) AS median_seconds, avg(tokens) AS mean_tokens, count(seconds) AS timed, CAST(sum(tokens) AS BIGINT) AS tokens
FROM j WHERE decision IS NOT NULL GROUP BY condition"""


def trace_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return m.inventory(turn_rows(spark, sf))


SQL["trace_inventory"] = f"""{W} SELECT count(DISTINCT trace_id) AS traces, count(DISTINCT (trace_id, seed)) AS replications, count(*) AS turns,
count(*) FILTER (role = 'clean') AS clean, count(*) FILTER (role = 'introducing') AS introducing, count(*) FILTER (role = 'persisting') AS persisting,
count(*) FILTER (role = 'no-change') AS no_change FROM t"""


def outcome_tally(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).groupBy("condition", "role", "decision").agg(F.count("*").alias("n"))


SQL["outcome_tally"] = f"{W} SELECT condition, role, decision, count(*) AS n FROM j GROUP BY ALL"


def per_event_recall(spark: SparkSession, sf: str) -> DataFrame:
    return stats.per_event_recall(judged(spark, sf))


RECALL = "pe AS (SELECT condition, trace_id, count(*) FILTER (decision = 'BLOCK') AS blocked, count(*) AS introduced FROM j WHERE role = 'introducing' GROUP BY ALL)"
SQL["per_event_recall"] = f"{W}, {RECALL} SELECT * FROM pe"
PAIRS = f"""{RECALL},
pd AS (SELECT b.trace_id, c.blocked * b.introduced - b.blocked * c.introduced AS num, b.introduced * c.introduced AS den
       FROM pe b JOIN pe c ON b.trace_id = c.trace_id WHERE b.condition = 'B' AND c.condition = 'C')"""


def paired_difference(spark: SparkSession, sf: str) -> DataFrame:
    return stats.paired(stats.per_event_recall(judged(spark, sf)), "B", "C")


SQL["paired_difference"] = f"{W}, {PAIRS} SELECT * FROM pd"


def signed_rank_parts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.signed_ranks(stats.paired(stats.per_event_recall(judged(spark, sf)), "B", "C"))


RANKS = f"""{PAIRS}, z AS (SELECT trace_id, CAST(sign(num) AS INTEGER) AS sign, abs(num) / den AS size FROM pd WHERE num <> 0),
rk AS (SELECT trace_id, sign, CAST(2 * rank() OVER (ORDER BY size) + count(*) OVER (PARTITION BY size) - 1 AS BIGINT) AS rank2 FROM z)"""
SQL["signed_rank_parts"] = f"{W}, {RANKS} SELECT * FROM rk"


def wilcoxon_exact_p(spark: SparkSession, sf: str) -> DataFrame:
    pairs = stats.paired(stats.per_event_recall(judged(spark, sf)), "B", "C")
    return stats.wilcoxon(stats.signed_ranks(pairs), pairs)


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    rows = stats.per_event_recall(judged(spark, sf)).withColumn("recall", F.col("blocked") / F.col("introduced"))
    return stats.bootstrap(rows, "condition", "recall", "trace_id")


def holm_adjust(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "supplier").groupBy("s_nationkey").agg(((F.min("s_acctbal") + 1000) / 20000).alias("p"))
    return stats.holm(rows)


SQL["holm_adjust"] = """WITH x AS (SELECT s_nationkey, (min(s_acctbal) + 1000) / 20000 AS p FROM supplier GROUP BY 1),
y AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, s_nationkey) + 1) * p) AS raw FROM x)
SELECT s_nationkey, p, max(raw) OVER (ORDER BY p, s_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjusted FROM y"""


def _findings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("rule"), F.col("l_suppkey").alias("file"), "l_returnflag")
    return rows.where("l_returnflag = 'N'").drop("l_returnflag"), rows.where("l_returnflag <> 'N'").drop("l_returnflag")


def findings_introduced(spark: SparkSession, sf: str) -> DataFrame:
    after, before = _findings(spark, sf)
    return fi.introduced(after, before, ["rule", "file"], ["l_orderkey", "l_linenumber"])


def findings_resolved(spark: SparkSession, sf: str) -> DataFrame:
    after, before = _findings(spark, sf)
    return fi.introduced(before, after, ["rule", "file"], ["l_orderkey", "l_linenumber"])


def _difference(a: str, b: str) -> str:
    return f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey AS rule, l_suppkey AS file, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn
FROM lineitem WHERE l_returnflag {a} 'N'), k AS (SELECT l_partkey AS rule, l_suppkey AS file, count(*) AS n FROM lineitem WHERE l_returnflag {b} 'N' GROUP BY ALL)
SELECT l_orderkey, l_linenumber, rule, file FROM x LEFT JOIN k USING (rule, file) WHERE rn > coalesce(n, 0)"""


SQL["findings_introduced"], SQL["findings_resolved"] = _difference("=", "<>"), _difference("<>", "=")


def finding_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_orderkey", "l_partkey")
    out = fi.items(rows, ["l_suppkey", "l_linenumber"], ["l_orderkey", "l_partkey"])
    return out.select("l_suppkey", "l_linenumber", F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["l_orderkey"].cast("string"), f["l_partkey"].cast("string"))), ",").alias("findings"), F.col("number").cast("long").alias("number"))


SQL["finding_items"] = """SELECT l_suppkey, l_linenumber, string_agg(l_orderkey || ':' || l_partkey, ',' ORDER BY l_orderkey, l_partkey) AS findings,
row_number() OVER (ORDER BY l_suppkey, l_linenumber) AS number FROM lineitem GROUP BY 1, 2"""


def flag_groups_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", "l_orderkey")
    out = fi.top_groups(rows, ["l_returnflag", "l_suppkey"], "l_orderkey")
    return out.select("l_returnflag", "l_suppkey", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.col("more").cast("long").alias("more"))


SQL["flag_groups_topk"] = """SELECT l_returnflag, l_suppkey, array_to_string(list_sort(list(l_orderkey))[1:4], ',') AS members, CAST(greatest(0, count(*) - 4) AS BIGINT) AS more
FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 8"""


def within_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return st.within_budget(rows, ["conv_id"], "turn", F.col("n"), 600).select("conv_id", "turn", F.col("n").cast("long").alias("n"), F.col("cut").cast("long").alias("cut"))


SQL["within_budget"] = """WITH x AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM conversations)
SELECT conv_id, turn, n, CAST(greatest(0, least(n, 600 - (run - n))) AS BIGINT) AS cut FROM x"""


def replay_before_after(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns.before_state(read(spark, sf, "conversations"), ["conv_id"], "turn", "text")
    return rows.select("conv_id", "turn", F.sha2("before", 256).alias("before_sha"), F.sha2("text", 256).alias("after_sha"), (~F.col("before").eqNullSafe(F.col("text"))).alias("changed"))


SQL["replay_before_after"] = """WITH x AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, sha256(b) AS before_sha, sha256(text) AS after_sha, b IS DISTINCT FROM text AS changed FROM x"""


def prompt_prefix_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").withColumn("grp", F.floor(F.col("conv_id") / 4).cast("long"))
    return st.are_prefixes(rows, "grp", "conv_id", "turn", "role")


SQL["prompt_prefix_check"] = """WITH l AS (SELECT conv_id // 4 AS grp, conv_id, list(role ORDER BY turn) AS v FROM conversations GROUP BY ALL),
m AS (SELECT grp, max_by(v, (len(v), conv_id)) AS top FROM l GROUP BY grp)
SELECT grp, count(*) AS members, bool_and(top[1:len(v)] = v) AS is_prefix FROM l JOIN m USING (grp) GROUP BY grp"""


def render_prompt(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("lines"))
    return rows.select("conv_id", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("prompt_hash"), F.size("lines").cast("long").alias("lines"))


SQL["render_prompt"] = """SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS prompt_hash, count(*) AS lines FROM conversations GROUP BY conv_id"""


def last_states(spark: SparkSession, sf: str) -> DataFrame:
    """How every replication ends: the last turn's struct wins."""
    rows = judged(spark, sf)
    return rows.groupBy("trace_id", "seed", "condition").agg(F.max_by("role", "iteration").alias("role"), F.max("iteration").alias("turns"))


SQL["last_states"] = f"{W} SELECT trace_id, seed, condition, max_by(role, iteration) AS role, max(iteration) AS turns FROM j GROUP BY ALL"


def streamed(rows: DataFrame, name: str, through) -> tuple[DataFrame, DataFrame]:
    """``rows`` written as files that hold any turns, taken two files at a time: the written rows, and what ``through`` makes of that stream."""
    import uuid

    from ..operators.graph import shared_folder

    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.repartition(6).write.parquet(f"{folder}/in")
    stream = through(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/in"), spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_turn_state(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming operator over the judged turns, in files of no order."""
    from ..streaming.turn_state import turn_states

    return streamed(judged(spark, sf), "turn-state", turn_states)[1]


SQL["stream_turn_state"] = f"{W} SELECT trace_id, seed, condition, iteration, caught, surviving FROM q"


def stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded turns against a run that repeats them, of which every 97th asks for something else and every 31st wasn't hashed."""
    from ..streaming.replay import compared, complete

    rows = turn_rows(spark, sf).select("trace_id", "seed", "iteration", "kind", "known", F.sha2(F.concat_ws("/", F.col("trace_id").cast("string"), F.col("seed").cast("string"), F.col("iteration").cast("string")), 256).alias("digest"))
    number = F.col("trace_id") * 7 + F.col("iteration")
    seen = rows.withColumn("digest", F.when(number % 31 == 0, F.lit(None)).when(number % 97 == 0, F.lit("other")).otherwise(F.col("digest")))
    begin = rows.select("trace_id", "seed").distinct().select("trace_id", "seed", F.lit(0).alias("iteration"), F.lit("init").alias("kind"), F.lit(None).cast("string").alias("known"), F.lit("start").alias("digest"))
    both = [side.union(begin).withColumn("side", F.lit(name)) for name, side in (("expected", rows), ("seen", seen))]
    records = both[0].union(both[1])
    return complete(*streamed(records, "replay", compared))


SQL["stream_replay"] = f"""{W},
z AS (SELECT trace_id, seed, iteration, label, (trace_id * 7 + iteration) % 31 = 0 AS bare, (trace_id * 7 + iteration) % 97 = 0 AND (trace_id * 7 + iteration) % 31 <> 0 AS other FROM l),
y AS (SELECT *, coalesce(max(CASE WHEN other THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, seed ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS broken FROM z)
SELECT trace_id, seed, iteration, label, CASE WHEN broken THEN 'after' WHEN other THEN 'diverged' WHEN bare THEN 'unchecked' ELSE 'same' END AS status FROM y"""

QUERIES = {f.__name__: f for f in (
    recall_at_introduction, turn_labels_locf, caught_surviving, detection_delay, detection_summary, degradation_curve, false_block_readings, overhead_medians, trace_inventory,
    outcome_tally, per_event_recall, paired_difference, signed_rank_parts, wilcoxon_exact_p, bootstrap_ci, holm_adjust, findings_introduced, findings_resolved, finding_items,
    flag_groups_topk, within_budget, replay_before_after, prompt_prefix_check, render_prompt, last_states, stream_turn_state, stream_replay)}
