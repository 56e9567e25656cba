"""The jobs as registered queries: run twice into one new folder, the output read back; and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltaloom.functions import text as tx
from deltaloom.operators.graph import shared_folder
from deltaloom.plans.adapters import POLICIES, TURNS

from . import judge_turns, scan_texts


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new. A pattern, as the table may be one file or a folder."""
    folder = _new_folder(spark, "job1")
    for _ in range(2):
        out = scan_texts.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/out", f"{folder}/progress")
    return out


def job2_judge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces what the first one wrote by the same."""
    folder, settings = _new_folder(spark, "job2"), {"policies": [{"condition": c, "threshold": x} for c, x in POLICIES]}
    for _ in range(2):
        out = judge_turns.run(spark, sf_dir, folder, settings)
    return out


_REVEALING = tx.REVEALING.replace("'", "''")
_LICENCE = (
    "CASE " + " ".join(f"WHEN contains(lower(text), '{m.lower()}') THEN '{n}'" for m, n in tx.LICENCE_MARKERS)
    + " WHEN contains(lower(text), 'redistribution and use in source and binary forms') AND contains(lower(text), 'neither the name') THEN 'BSD-3-Clause'"
    + " WHEN contains(lower(text), 'redistribution and use in source and binary forms') THEN 'BSD-2-Clause' END"
)

SQL = {
    "job1_scan_texts": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, coalesce(nullif(lang, ''), 'none') AS language FROM documents),
s AS (SELECT *, sha256(text) AS blob, {_LICENCE} AS licence, string_split(text, chr(10)) AS l FROM d)
SELECT doc_id, lang, source, blob, language, length(text) AS chars, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens, CAST(len(list_filter(l, lambda x: trim(x) <> '')) AS BIGINT) AS lines, licence,
       CASE WHEN licence IN ({', '.join(f"'{x}'" for x in tx.PERMISSIVE)}) THEN 'permissive' WHEN licence IN ({', '.join(f"'{x}'" for x in tx.PERMISSIVE_EQUIVALENT)}) THEN 'confirm' WHEN licence IS NOT NULL THEN 'excluded' END AS status,
       regexp_matches(text, '{_REVEALING}') AS revealing, CAST(len(list_filter(l, lambda x: regexp_matches(x, '{_REVEALING}'))) AS BIGINT) AS revealing_lines FROM s
""",
    "job2_judge_turns": f"""
WITH {TURNS},
n AS (SELECT condition, count(*) FILTER (role = 'introducing') AS introduced, count(*) FILTER (role = 'introducing' AND decision = 'BLOCK') AS blocked, count(*) FILTER (role = 'clean') AS clean_turns,
             count(*) FILTER (role = 'clean' AND decision = 'BLOCK') AS clean_blocked, count(*) FILTER (surviving) AS surviving_turns, median(seconds) FILTER (decision IS NOT NULL) AS median_seconds FROM q GROUP BY condition),
f AS (SELECT condition, count(*) AS regressions, count(caught_at) AS detected, count(*) FILTER (caught_at = introduced_at) AS on_arrival FROM d GROUP BY condition)
SELECT trace_id, seed, iteration, scope, kind, label, basis, role, present, seconds, tokens, decision, caught, surviving, q.condition, n.introduced, n.blocked, clean_turns, clean_blocked,
       coalesce(regressions, 0) AS regressions, coalesce(detected, 0) AS detected, coalesce(on_arrival, 0) AS on_arrival, median_seconds, surviving_turns
FROM q JOIN n USING (condition) LEFT JOIN f USING (condition)
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_scan_texts, job2_judge_turns)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
