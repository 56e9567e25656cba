"""Queries for parsing, reports and totals on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fixes, measures, reports
from ..operators import states as st
from .adapters import TURNS, judged, read, turns

SQL: dict[str, str] = {}


def overhead_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Judged turns with a part of their seconds for each stage; blocked ones called a model."""
    rows = judged(spark, sf).where("decision IS NOT NULL").select(
        "condition", F.when(F.col("iteration") % 3 == 0, F.col("seconds")).alias("scan_seconds"), (F.col("seconds") / 128).alias("graph_seconds"), (F.col("tokens") * 10).alias("triage_ms"),
        (F.col("decision") == "BLOCK").alias("model_call"), F.col("tokens").alias("input_tokens"), F.when(F.col("tokens") % 2 == 0, F.col("tokens")).alias("output_tokens"),
    )
    return measures.full_overhead(rows)


SQL["overhead_parts"] = f"""WITH {TURNS}, x AS (SELECT condition, CASE WHEN iteration % 3 = 0 THEN seconds END AS scan, seconds / 128 AS graph, tokens * 10 AS triage, decision = 'BLOCK' AS call, tokens FROM j WHERE decision IS NOT NULL)
SELECT condition, median(graph) AS median_graph_seconds, median(triage / 1000) FILTER (call) AS median_triage_seconds, median(scan) AS median_scan_seconds,
median(scan + coalesce(graph, 0) + coalesce(triage, 0) / 1000) AS median_added_seconds, count(scan) AS timed, count(*) FILTER (call) AS model_calls,
round(avg(tokens) FILTER (call), 1) AS mean_input_tokens, round(avg(tokens) FILTER (call AND tokens % 2 = 0), 1) AS mean_output_tokens FROM x GROUP BY condition"""


def shown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """What of a conversation is shown within 700 characters, sentences as lines."""
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\. ", ".\n").alias("text"))
    out = st.shown_blocks(rows, ["conv_id"], "turn", "text", 700)
    return out.select("conv_id", "turn", F.sha2("shown", 256).alias("shown_sha"), F.length("shown").cast("long").alias("length"), "hidden")


SQL["shown_blocks"] = r"""WITH c AS (SELECT conv_id, turn, replace(text, '. ', '.' || chr(10)) AS text FROM conversations),
x AS (SELECT *, 700 - (sum(length(text)) OVER w - length(text)) AS remaining, count(*) OVER (PARTITION BY conv_id) - row_number() OVER w AS rest FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
y AS (SELECT *, length(text) > remaining AS cut, CAST(sum(CASE WHEN length(text) > remaining THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cuts FROM x),
z AS (SELECT *, CASE WHEN NOT cut THEN text ELSE CASE WHEN contains(left(text, CAST(greatest(remaining, 0) AS BIGINT)), chr(10))
      THEN array_to_string(string_split(left(text, CAST(greatest(remaining, 0) AS BIGINT)), chr(10))[:-2], chr(10)) ELSE left(text, CAST(greatest(remaining, 0) AS BIGINT)) END END AS shown FROM y WHERE cuts = 0 OR (cuts = 1 AND cut))
SELECT conv_id, turn, sha256(shown) AS shown_sha, length(shown) AS length, CASE WHEN cut THEN rest END AS hidden FROM z"""


def changed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a change's counts, with renames and binary files, made from parts and read back."""
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("lib/{old => new"), k, F.lit("}/m.py"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("a"), k, F.lit(".py => Tests/b"), k, F.lit(".py")))
    path = path.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("src/{sub"), k, F.lit(" => }/x.py"))).otherwise(F.concat(F.lit("docs/"), k, F.lit(".png")))
    added = F.when(F.col("p_partkey") % 4 == 3, "-").otherwise(F.col("p_size").cast("string"))
    rows = read(spark, sf, "part").select("p_partkey", tx.changed_line(F.concat_ws("\t", added, added, path)).alias("c"), tx.status_of_line(F.concat(F.lit("R100\told\t"), k)).alias("s"))
    return rows.select("p_partkey", "c.path", F.col("c.added").cast("long").alias("added"), "c.kind", F.concat_ws(":", "s.status", "s.path").alias("status"))


SQL["changed_lines"] = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'lib/new' || p_partkey || '/m.py' WHEN 1 THEN 'Tests/b' || p_partkey || '.py' WHEN 2 THEN 'src/x.py' ELSE 'docs/' || p_partkey || '.png' END AS path,
CASE WHEN p_partkey % 4 <> 3 THEN CAST(p_size AS BIGINT) END AS added, CASE p_partkey % 4 WHEN 1 THEN 'py-test' WHEN 3 THEN 'other' ELSE 'py-source' END AS kind, 'R:' || p_partkey AS status FROM part"""


def declared_cwes(spark: SparkSession, sf: str) -> DataFrame:
    """Weaknesses that rule files declare, made from parts: on the line, or in a list; those in messages don't count."""
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    one = F.concat(F.lit('rules:\n- id: a\n  message: see CWE-1\n  metadata:\n    cwe: "CWE-'), n, F.lit(': x"\n    owasp: A1\n'))
    many = F.concat(F.lit("rules:\n- metadata:\n    cwe:\n    - 'CWE-"), n, F.lit(": x'\n    - 'CWE-"), size, F.lit(": y'\n    references:\n    - CWE-2\n"))
    rows = read(spark, sf, "part").select("p_partkey", tx.declared_cwes(F.when(F.col("p_partkey") % 2 == 0, one).otherwise(many)).alias("cwes"))
    return rows.select("p_partkey", F.array_join(F.transform("cwes", lambda c: c.cast("string")), ",").alias("cwes"))


SQL["declared_cwes"] = """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_partkey = p_size THEN CAST(p_partkey AS VARCHAR)
ELSE least(p_partkey, p_size) || ',' || greatest(p_partkey, p_size) END AS cwes FROM part"""


def licence_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by whether the licence they quote is permissive."""
    return read(spark, sf, "documents").groupBy("source", tx.licence_status(tx.licence_family(F.col("text"))).alias("status")).agg(F.count("*").alias("n"))


SQL["licence_statuses"] = """WITH l AS (SELECT source, lower(text) AS t FROM documents),
f AS (SELECT source, CASE WHEN contains(t, 'gnu affero general public license') OR contains(t, 'gnu lesser general public license') OR contains(t, 'gnu general public license') OR contains(t, 'mozilla public license') THEN 'excluded'
      WHEN contains(t, 'apache license') OR contains(t, 'permission is hereby granted, free of charge') THEN 'permissive' WHEN contains(t, 'permission to use, copy, modify, and/or distribute') THEN 'confirm'
      WHEN contains(t, 'redistribution and use in source and binary forms') THEN 'permissive' ELSE 'excluded' END AS status FROM l)
SELECT source, status, count(*) AS n FROM f GROUP BY ALL"""


def _advisories(spark: SparkSession, sf: str) -> DataFrame:
    repo = F.concat(F.lit("org"), (F.col("o_custkey") % 7).cast("string"), F.lit("/proj"), (F.col("o_custkey") % 40).cast("string"), F.when(F.col("o_custkey") % 40 < 5, "_legacy").otherwise(""))
    fix = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")))
    vulnerable = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("v"), (F.col("o_orderkey") % 2).cast("string")))
    return read(spark, sf, "orders").select(repo.alias("repo"), fix.alias("fix"), vulnerable.alias("vulnerable"), F.concat(F.lit("GHSA-"), (F.col("o_orderkey") % 97).cast("string"), F.lit("-x")).alias("advisory"), (F.col("o_orderkey") % 60_000).alias("lines"))


ADVISORIES = """adv AS (SELECT 'org' || o_custkey % 7 || '/proj' || o_custkey % 40 || CASE WHEN o_custkey % 40 < 5 THEN '_legacy' ELSE '' END AS repo, 'proj' || o_custkey % 40 AS proj,
CASE WHEN o_orderkey % 5 <> 0 THEN 'f' || o_orderkey % 3 END AS fix, CASE WHEN o_orderkey % 5 <> 0 THEN 'v' || o_orderkey % 2 END AS vulnerable, 'GHSA-' || o_orderkey % 97 || '-x' AS advisory, o_orderkey % 60000 AS lines FROM orders)"""


def grouped_events(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.grouped_events(_advisories(spark, sf), 5_000, 50_000)
    return out.select("repo", "fix", "vulnerable", "event_id", F.array_join("advisories", ",").alias("advisories"))


SQL["grouped_events"] = f"""WITH {ADVISORIES}, g AS (SELECT repo, proj, fix, vulnerable, list_sort(list_distinct(list(advisory))) AS a FROM adv WHERE vulnerable IS NOT NULL AND lines BETWEEN 5000 AND 50000 GROUP BY ALL)
SELECT repo, fix, vulnerable, proj || '-' || string_split(a[1], '-')[2] AS event_id, array_to_string(a, ',') AS advisories FROM g"""


def advisories_by_repository(spark: SparkSession, sf: str) -> DataFrame:
    rows = _advisories(spark, sf)
    plain = F.regexp_replace("repo", "_legacy$", "")
    repos = rows.select(plain.alias("repo"), F.when(F.col("repo").endswith("_legacy"), F.col("repo")).alias("alias")).distinct()
    return reports.by_repository(rows.where("fix IS NOT NULL"), rows.where("fix IS NULL"), repos)


SQL["advisories_by_repository"] = f"""WITH {ADVISORIES} SELECT regexp_replace(repo, '_legacy$', '') AS repo, count(DISTINCT advisory) AS advisories, count(DISTINCT fix) AS fixes FROM adv GROUP BY 1"""


def _leaks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    path = lambda k: F.when(k % 6 == 0, F.concat(F.lit("pkg/tests/t"), k.cast("string"), F.lit(".py"))).when(k % 6 == 1, F.lit("tests.py")).otherwise(F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py")))
    files = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("event_id"), path(F.col("s_suppkey") % 30).alias("path"))
    near = read(spark, sf, "customer").select(F.col("c_nationkey").alias("event_id"), path(F.col("c_custkey") % 30).alias("path"), F.concat(F.lit("f"), (F.col("c_custkey") % 11).cast("string")).alias("symbol"))
    return files, near.where("event_id % 2 = 0")


LEAKS = """pth AS (SELECT k, CASE k % 6 WHEN 0 THEN 'pkg/tests/t' || k || '.py' WHEN 1 THEN 'tests.py' ELSE 'src/m' || k || '.py' END AS path, k % 6 < 2 AS test FROM range(30) r(k)),
ff AS (SELECT DISTINCT s_nationkey AS event_id, path, test FROM supplier JOIN pth ON k = s_suppkey % 30),
nr AS (SELECT DISTINCT c_nationkey AS event_id, path, 'f' || c_custkey % 11 AS symbol FROM customer JOIN pth ON k = c_custkey % 30 WHERE c_nationkey % 2 = 0),
ex AS (SELECT event_id, path, NULL AS symbol, 'fix-test' AS reason FROM ff WHERE test UNION ALL
       SELECT event_id, path, symbol, 'near-duplicate' FROM nr WHERE NOT EXISTS (SELECT 1 FROM ff WHERE test AND ff.event_id = nr.event_id AND ff.path = nr.path))"""


def leakage_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.exclusions(*_leaks(spark, sf))


SQL["leakage_exclusions"] = f"WITH {LEAKS} SELECT * FROM ex"


def leakage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.leakage_totals(*_leaks(spark, sf))


SQL["leakage_totals"] = f"""WITH {LEAKS} SELECT (SELECT count(DISTINCT event_id) FROM ff) AS events, (SELECT count(*) FROM ff WHERE test) AS fix_tests_excluded, (SELECT count(*) FROM ff WHERE NOT test) AS fix_sources_left_in_scope,
(SELECT count(DISTINCT event_id) FROM ex) AS events_with_exclusions, (SELECT count(*) FROM ex) AS exclusions, (SELECT count(DISTINCT event_id) FROM nr) AS events_with_near_duplicates, (SELECT count(*) FROM nr) AS near_duplicates"""


def trace_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Replications of events: every fifth reply is cached, the injection is the first regression, errors end a trace."""
    rows = turns(spark, sf).select("trace_id", "seed", "iteration", F.when(F.col("kind") == "turn", "turn").otherwise("error").alias("kind"), "tokens", (F.col("iteration") % 5 == 0).alias("cached"), F.col("introduced").alias("injected"))
    plans = rows.select("trace_id").distinct().select("trace_id", F.lit(6).alias("planned_turns"), (F.col("trace_id") % 4 + 2).cast("int").alias("injection_turn"))
    return reports.trace_summaries(rows, plans)


SQL["trace_summaries"] = f"""WITH {TURNS}, x AS (SELECT trace_id, seed, coalesce(max(iteration) FILTER (kind = 'turn'), 0) AS turns, max_by(kind, iteration) AS final, CAST(coalesce(sum(tokens) FILTER (iteration % 5 <> 0), 0) AS BIGINT) AS billed,
min(iteration) FILTER (introduced) AS injected_at FROM t GROUP BY ALL)
SELECT trace_id, seed, turns, CASE WHEN final <> 'turn' THEN 'error' WHEN turns >= 6 THEN 'complete' ELSE 'incomplete' END AS ended, billed,
CASE WHEN injected_at IS NULL THEN 'not-reached' WHEN injected_at = trace_id % 4 + 2 THEN 'as-planned' ELSE 'elsewhere' END AS injection FROM x"""


def label_tally(spark: SparkSession, sf: str) -> DataFrame:
    return reports.label_tally(turns(spark, sf))


SQL["label_tally"] = f"WITH {TURNS} SELECT iteration, label, count(*) AS n, count(*) FILTER (basis = 'carried') AS carried FROM t WHERE label IS NOT NULL GROUP BY ALL"


def largest_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """The ten suppliers with the most returned lines."""
    return reports.largest(read(spark, sf, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R")


SQL["largest_unknown"] = "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10"


def occurrence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return reports.occurrences(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


SQL["occurrence_numbers"] = "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS occurrence FROM lineitem"


def public_names(spark: SparkSession, sf: str) -> DataFrame:
    """Qualified names made from parts' types: every third has a private part, every fourth one between double underscores."""
    name = F.regexp_replace(F.lower("p_type"), " ", ".")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), name)).when(F.col("p_partkey") % 4 == 0, F.concat(name, F.lit(".__init__"))).otherwise(name)
    return read(spark, sf, "part").select("p_partkey", tx.is_public_name(name).alias("public"), tx.is_leakage_test(F.concat(name, F.lit("/test.py"))).alias("test"), tx.rounded(F.col("p_partkey") / 8, 1).cast("double").alias("rounded"))


SQL["public_names"] = """SELECT p_partkey, p_partkey % 3 <> 0 AS public, true AS test, round_even(p_partkey / 8, 1) AS rounded FROM part"""

def budget_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as groups of requests, of which equal ones are asked once: which users run on a budget of 400 calls, when
    the answers to purchases are known already."""
    rows = read(spark, sf, "events").select("user_id", F.concat_ws("/", "event_type", F.floor("value").cast("string")).alias("request"))
    cached = rows.where("startswith(request, 'purchase/')").select("request")
    return st.admitted(rows, "user_id", "request", 400, cached)


SQL["budget_stop"] = """WITH r AS (SELECT user_id, event_type || '/' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS request FROM events),
f AS (SELECT request, min(user_id) AS user_id FROM r WHERE NOT starts_with(request, 'purchase/') GROUP BY request),
g AS (SELECT user_id, count(*) AS requests, (SELECT count(*) FROM f WHERE f.user_id = r.user_id) AS calls FROM r WHERE user_id IS NOT NULL GROUP BY user_id),
t AS (SELECT *, CAST(coalesce(sum(calls) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM g)
SELECT user_id, requests, calls, before, before < 400 AS admitted FROM t"""


def fix_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as advisories that link their suppliers as commits; a supplier's parts are the files that its commit changes."""
    orders, lines = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    parents = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.array(name(k - 1), name(k - 2))).otherwise(F.array(name(k - 1)))
    at = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.when(k % 2 == 0, "T01:00:00+03:00").otherwise("T00:30:00Z"))
    commits = read(spark, sf, "supplier").where(k % 11 != 0).select(name(k).alias("sha"), parents.alias("parents"), at.alias("committed_at"), (k % 3 != 0).alias("on_default"))
    licences = read(spark, sf, "supplier").select(name(k).alias("sha"), F.when(k % 4 == 1, "MIT").when(k % 4 == 2, "ISC").when(k % 4 == 3, "GPL").alias("detected"))
    asked = orders.select(F.col("o_orderkey").alias("advisory"), F.when(F.col("o_orderkey") % 3 == 0, "MIT").when(F.col("o_orderkey") % 3 == 1, "LGPL").alias("licence"))
    links = lines.where("l_orderkey % 10 <> 4").select(F.col("l_orderkey").alias("advisory"), F.col("l_linenumber").alias("place"), name(F.col("l_suppkey")).alias("sha"))
    suffix = F.when(F.col("l_partkey") % 6 < 2, ".py").when(F.col("l_partkey") % 6 < 5, ".js").otherwise(".md")
    path = F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), suffix)
    files = lines.where("l_suppkey % 13 <> 6 OR l_partkey % 6 > 1").select(name(F.col("l_suppkey")).alias("sha"), name(F.col("l_suppkey") - 1).alias("base"), path.alias("path"), F.col("l_quantity").cast("long").alias("added"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("long")).alias("deleted"))
    given = orders.where("o_orderkey % 16 = 1").select(F.col("o_orderkey").alias("advisory"), F.lit("c0").alias("vulnerable"), (F.col("o_orderkey") % 32 == 1).alias("is_ancestor"))
    out = fixes.resolved_fixes(asked, links, commits, files, licences, given)
    return out.select("advisory", "fix", "vulnerable", F.coalesce("python_files", F.lit(-1)).alias("python_files"), "licence", F.array_join("flags", "|").alias("flags"))


SQL["fix_resolution"] = """
WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 0 WHEN s_suppkey % 5 = 0 THEN 2 ELSE 1 END AS parents,
                  make_timestamp(2024, 1, CAST(s_suppkey % 28 + 1 AS BIGINT), 0, 0, 0) + CASE WHEN s_suppkey % 2 = 0 THEN INTERVAL (-120) MINUTE ELSE INTERVAL 30 MINUTE END AS ts FROM supplier WHERE s_suppkey % 11 <> 0),
l AS (SELECT l_orderkey AS advisory, c.k, parents, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN c.k % 3 <> 0 THEN 0 ELSE 1 END, ts, l_linenumber, 'c' || c.k) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS known
      FROM lineitem JOIN c ON c.k = l_suppkey WHERE l_orderkey % 10 <> 4),
a AS (SELECT o_orderkey AS advisory, CASE o_orderkey % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'LGPL' END AS today, o_orderkey % 10 <> 4 AND o_orderkey IN (SELECT l_orderkey FROM lineitem) AS linked, l.k, l.parents, l.known,
             o_orderkey % 16 = 1 AS given, o_orderkey % 32 = 1 AS anc FROM orders LEFT JOIN l ON l.advisory = o_orderkey AND rn = 1),
g AS (SELECT *, k IS NOT NULL AND (CASE WHEN given THEN anc ELSE parents > 0 END) AS goes, CASE WHEN given THEN 0 ELSE k - 1 END AS v FROM a),
f AS (SELECT l_suppkey AS k, count(*) FILTER (l_partkey % 6 < 2) AS pf, coalesce(sum(CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END) FILTER (l_partkey % 6 < 2), 0) AS pl,
             coalesce(sum(CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END) FILTER (l_partkey % 6 BETWEEN 2 AND 4), 0) AS ol FROM lineitem WHERE l_suppkey % 13 <> 6 OR l_partkey % 6 > 1 GROUP BY l_suppkey),
m AS (SELECT g.*, CASE WHEN v = g.k - 1 THEN coalesce(pf, 0) ELSE 0 END AS pf, CASE WHEN v = g.k - 1 THEN pl ELSE 0 END AS pl, CASE WHEN v = g.k - 1 THEN ol ELSE 0 END AS ol,
             CASE WHEN v IN (SELECT s_suppkey FROM supplier) THEN CASE v % 4 WHEN 1 THEN 'MIT' WHEN 2 THEN 'ISC' WHEN 3 THEN 'GPL' END END AS lic FROM g LEFT JOIN f ON f.k = g.k)
SELECT advisory, CASE WHEN goes THEN 'c' || k END AS fix, CASE WHEN goes THEN 'c' || v END AS vulnerable, CASE WHEN goes THEN CAST(pf AS BIGINT) ELSE -1 END AS python_files, CASE WHEN goes THEN lic END AS licence,
       array_to_string(list_filter([CASE WHEN NOT linked THEN 'no fix commit linked by the advisory' END, CASE WHEN linked AND k IS NULL THEN 'no fix commit could be resolved' END, CASE WHEN k % 3 = 0 THEN 'no fix commit is on the default branch' END,
         CASE WHEN known > 1 THEN known || ' candidate fix commits (backports or multi-part fix)' END, CASE WHEN k IS NOT NULL AND given AND NOT anc THEN 'given vulnerable commit c0 is not an ancestor of the fix' END,
         CASE WHEN NOT given AND parents = 0 THEN 'fix commit has no parent (root commit)' END, CASE WHEN goes AND NOT given AND parents > 1 THEN 'fix commit is a merge; diff taken against its first parent' END,
         CASE WHEN goes AND pf = 0 THEN 'fix changes no Python source file' END,
         CASE WHEN goes AND pf > 0 AND ol > pl THEN 'fix changes more non-Python code (' || ol || ' lines) than Python source (' || pl || ' lines); check the vulnerable code is Python' END,
         CASE WHEN goes AND lic IS NULL THEN 'licence at vulnerable commit not recognised; check by hand' END, CASE WHEN goes AND today = 'MIT' AND lic <> today THEN 'licence at vulnerable commit looks like ' || lic || ', not MIT as today' END],
         lambda x: x IS NOT NULL), '|') AS flags FROM m"""


QUERIES = {f.__name__: f for f in (
    overhead_parts, shown_blocks, changed_lines, declared_cwes, licence_statuses, grouped_events, advisories_by_repository, leakage_exclusions, leakage_totals, trace_summaries, label_tally, largest_unknown,
    occurrence_numbers, public_names, budget_stop, fix_resolution)}
