"""Queries on documents, pages and the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import facts
from ..operators import similarity as sim
from ..operators import states as st
from .adapters import read

SQL: dict[str, str] = {}


def licence_family(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tx.licence_family(F.col("text")).alias("licence"))


SQL["licence_family"] = (
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN contains(lower(text), '{m.lower()}') THEN '{n}'" for m, n in tx.LICENCE_MARKERS)
    + " WHEN contains(lower(text), 'redistribution and use in source and binary forms') AND contains(lower(text), 'neither the name') THEN 'BSD-3-Clause'"
    + " WHEN contains(lower(text), 'redistribution and use in source and binary forms') THEN 'BSD-2-Clause' END AS licence FROM documents"
)


def scrub_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the lines that speak of a licence or of a way to reach somebody."""
    left = tx.without_lines(F.col("text"), r"(?i)licen[cs]e|copyright|contact|@")
    return read(spark, sf, "documents").select("doc_id", F.sha2(left, 256).alias("kept_sha"), (F.length("text") - F.length(left)).cast("long").alias("removed"))


SQL["scrub_lines"] = r"""WITH x AS (SELECT doc_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '(?i)licen[cs]e|copyright|contact|@')), chr(10)) AS kept FROM documents)
SELECT doc_id, sha256(kept) AS kept_sha, length(text) - length(kept) AS removed FROM x"""


def approx_tokens_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy("source").agg(
        F.sum(tx.approx_tokens(F.col("text"))).alias("tokens"), F.sum(F.length("text")).alias("chars"), F.sum(tx.filled_lines(F.col("text"))).alias("lines"), F.count("*").alias("docs")
    )


SQL["approx_tokens_by_source"] = """SELECT source, CAST(sum(ceil(length(text) / 3.5)) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars,
CAST(sum(len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''))) AS BIGINT) AS lines, count(*) AS docs FROM documents GROUP BY source"""


def trigram_resemblance_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five benchmark passages nearest to each document that shares a run of three words with one."""
    docs = read(spark, sf, "documents").select("doc_id", sim.tokens(F.col("text")).alias("words"))
    items = read(spark, sf, "benchmark").select("item_id", sim.tokens(F.col("text")).alias("words"))
    return sim.nearest(docs, items, "doc_id", "item_id", "words").select("doc_id", "item_id", "shared", "total", F.col("rank").cast("long").alias("rank"))


_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _grams(key: str, table: str) -> str:
    return f"""(SELECT {key}, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram
    FROM (SELECT {key}, {_WORDS} AS w FROM {table}) WHERE len(w) > 0)"""


SQL["trigram_resemblance_top5"] = f"""WITH a AS (SELECT doc_id, gram, count(*) AS c FROM {_grams('doc_id', 'documents')} GROUP BY ALL),
b AS (SELECT item_id, gram, count(*) AS c FROM {_grams('item_id', 'benchmark')} GROUP BY ALL),
na AS (SELECT doc_id, sum(c) AS n FROM a GROUP BY 1), nb AS (SELECT item_id, sum(c) AS n FROM b GROUP BY 1),
s AS (SELECT doc_id, item_id, CAST(sum(least(a.c, b.c)) AS BIGINT) AS shared FROM a JOIN b USING (gram) GROUP BY ALL),
t AS (SELECT doc_id, item_id, shared, CAST(na.n + nb.n - shared AS BIGINT) AS total FROM s JOIN na USING (doc_id) JOIN nb USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared / total DESC, item_id) AS rank FROM t) SELECT doc_id, item_id, shared, total, rank FROM r WHERE rank <= 5"""


def near_duplicate_length_bound(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents the length bound leaves for each benchmark passage, by language."""
    docs = read(spark, sf, "documents").select("doc_id", F.lit("text").alias("kind"), F.size(sim.tokens(F.col("text"))).alias("n"), "lang")
    items = read(spark, sf, "benchmark").select("item_id", F.lit("text").alias("kind"), F.size(sim.tokens(F.col("text"))).alias("n"))
    # lengths are few: counting documents by length first keeps the join small however many documents there are
    by_length = docs.groupBy("kind", "lang", "n").agg(F.count("*").alias("docs"))
    pairs = sim.length_bounded(items, by_length, "kind")
    return pairs.groupBy(F.col("item_id_a").alias("item_id"), F.col("lang_b").alias("lang")).agg(F.sum("docs_b").alias("candidates"))


SQL["near_duplicate_length_bound"] = f"""WITH d AS (SELECT doc_id, lang, len({_WORDS}) AS n FROM documents), i AS (SELECT item_id, len({_WORDS}) AS n FROM benchmark)
SELECT item_id, lang, count(*) AS candidates FROM i JOIN d ON i.n >= 30 AND d.n >= 30 AND 200 * least(i.n, d.n) >= 80 * (i.n + d.n) GROUP BY ALL"""


def _scanned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = lambda table, key: read(spark, sf, table).select(key, F.lit("text").alias("kind"), sim.tokens(F.coalesce("text", F.lit(""))).alias("words"))
    return rows("benchmark", "item_id"), rows("documents", "doc_id")


def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of a passage and a document that the bag bound leaves at 0.2, each of ten words at least."""
    return sim.near_pairs(*_scanned(spark, sf), "item_id", "doc_id", "kind", "words", 20, 10).select("item_id", "doc_id", "common", "total")


SQL["near_duplicate_pairs"] = f"""WITH a AS (SELECT item_id, {_WORDS} AS w FROM benchmark), b AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(w) AS t FROM a WHERE len(w) >= 10) GROUP BY ALL), y AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(w) AS t FROM b WHERE len(w) >= 10) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(least(x.c, y.c)) AS BIGINT) AS common FROM x JOIN y USING (t) GROUP BY ALL)
SELECT item_id, doc_id, common, CAST(len(a.w) + len(b.w) AS BIGINT) AS total FROM s JOIN a USING (item_id) JOIN b USING (doc_id) WHERE 200 * common >= 20 * (len(a.w) + len(b.w))"""


def near_duplicate_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """The order-aware ratio of all those pairs that reach 0.2."""
    return sim.near_duplicates(*_scanned(spark, sf), "item_id", "doc_id", "kind", "words", 20, 10).select("doc_id", "item_id", "ratio")


def commit_url_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Host, path depth and last part of page addresses."""
    url = F.col("url")
    path = F.regexp_extract(url, r"^https?://[^/]+/?([^?#]*)", 1)
    return read(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract(url, r"^https?://([^/:]+)", 1)).alias("host"), F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("long").alias("depth"), F.element_at(F.split(path, "/"), -1).alias("last"))


SQL["commit_url_parse"] = r"""SELECT page_id, lower(regexp_extract(url, '^https?://([^/:]+)', 1)) AS host,
CAST(len(list_filter(string_split(regexp_extract(url, '^https?://[^/]+/?([^?#]*)', 1), '/'), lambda p: p <> '')) AS BIGINT) AS depth,
string_split(regexp_extract(url, '^https?://[^/]+/?([^?#]*)', 1), '/')[-1] AS last FROM pages"""


def longest_prefix_match(spark: SparkSession, sf: str) -> DataFrame:
    """For each part name, the longest of the brands' and types' leading words that it begins with."""
    names = read(spark, sf, "part").select(F.col("p_type").alias("name")).distinct()
    known = read(spark, sf, "part").select(F.regexp_extract("p_type", r"^\S+(?: \S+)?", 0).alias("prefix")).distinct()
    return facts.longest_prefix(names, known, "name", "prefix", " ")


SQL["longest_prefix_match"] = r"""WITH k AS (SELECT DISTINCT regexp_extract(p_type, '^\S+(?: \S+)?', 0) AS prefix FROM part), n AS (SELECT DISTINCT p_type AS name FROM part)
SELECT name, max_by(prefix, length(prefix)) AS prefix FROM n JOIN k ON name = prefix OR starts_with(name, prefix || ' ') GROUP BY name"""


def name_resolution_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of parts looked up among suppliers, then customers, then parts: the first that has it says what it is."""
    part = read(spark, sf, "part")
    keys = part.select(F.col("p_partkey").alias("key"))
    scopes = [
        ("supplier", read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))),
        ("customer", read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))),
        ("part", part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))),
    ]
    return facts.first_match(keys, scopes, "key", "value")


SQL["name_resolution_priority"] = """SELECT p_partkey AS key, coalesce(s_name, c_name, p_name) AS value, CASE WHEN s_name IS NOT NULL THEN 'supplier' WHEN c_name IS NOT NULL THEN 'customer' ELSE 'part' END AS scope
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN customer ON c_custkey = p_partkey"""


def scope_local_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Is an order served by suppliers of one nation, or across nations?"""
    line, supp = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = line.join(supp, "l_suppkey").groupBy("l_orderkey").agg(F.countDistinct("s_nationkey").alias("nations"))
    return rows.groupBy(F.when(F.col("nations") == 1, "local").otherwise("cross").alias("scope")).agg(F.count("*").alias("orders"), F.max("nations").alias("most"))


SQL["scope_local_cross"] = """WITH x AS (SELECT l_orderkey, count(DISTINCT s_nationkey) AS nations FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT CASE WHEN nations = 1 THEN 'local' ELSE 'cross' END AS scope, count(*) AS orders, max(nations) AS most FROM x GROUP BY 1"""


def advisory_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Why orders drop out on the way: the first reason counts."""
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey", "left")
    rows = st.funnel(rows, [("withdrawn", F.col("o_orderstatus") == "F"), ("no customer", F.col("c_acctbal").isNull()), ("in debt", F.col("c_acctbal") < 0), ("small", F.col("o_totalprice") < 50000)])
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


SQL["advisory_funnel"] = """SELECT CASE WHEN o_orderstatus = 'F' THEN 'withdrawn' WHEN c_acctbal IS NULL THEN 'no customer' WHEN c_acctbal < 0 THEN 'in debt' WHEN o_totalprice < 50000 THEN 'small' ELSE 'kept' END AS reason, count(*) AS n
FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1"""


def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return st.first_of(read(spark, sf, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


SQL["dedupe_keep_first"] = "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1"


def argmax_repo(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's clerk of choice: the priority with the most orders, ties to the smallest name."""
    n = read(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("n"), "o_orderpriority"))
    return n.withColumn("rn", best).where("rn = 1").drop("rn")


SQL["argmax_repo"] = """WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM n) SELECT o_custkey, o_orderpriority, n FROM r WHERE rn = 1"""


def exclusion_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    gone = read(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return read(spark, sf, "documents").join(gone, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


SQL["exclusion_anti_join"] = """SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) GROUP BY 1"""


def canonical_hash(spark: SparkSession, sf: str) -> DataFrame:
    return tx.canonical_hash(read(spark, sf, "nation"), "n_nationkey", "n_name", by="n_nationkey")


SQL["canonical_hash"] = "SELECT sha256(string_agg(n_nationkey || chr(9) || n_name, chr(10) ORDER BY n_nationkey)) AS digest FROM nation"


def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' last prices before and after a date as two states, compared."""
    orders = read(spark, sf, "orders")
    split = F.lit("1998-04-15").cast("timestamp")
    state = lambda df: df.groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("v"))
    return st.changes(state(orders.where(F.col("o_orderdate") < split)), state(orders.where(F.col("o_orderdate") >= split)), ["o_custkey"], "v")


SQL["snapshot_changes"] = """WITH s AS (SELECT o_orderdate < TIMESTAMP '1998-04-15' AS early, o_custkey, max_by(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY ALL),
x AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.v AS old, b.v AS new, a.o_custkey IS NULL AS added, b.o_custkey IS NULL AS removed
      FROM (SELECT * FROM s WHERE early) a FULL JOIN (SELECT * FROM s WHERE NOT early) b ON a.o_custkey = b.o_custkey)
SELECT o_custkey, old, new, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'modified' END AS change FROM x WHERE added OR removed OR old IS DISTINCT FROM new"""

QUERIES = {f.__name__: f for f in (
    licence_family, scrub_lines, approx_tokens_by_source, trigram_resemblance_top5, near_duplicate_length_bound, near_duplicate_pairs, near_duplicate_ratio, commit_url_parse, longest_prefix_match,
    name_resolution_priority, scope_local_cross, advisory_funnel, dedupe_keep_first, argmax_repo, exclusion_anti_join, canonical_hash, snapshot_changes)}
