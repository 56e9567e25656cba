"""The jobs: growing input, repeated batches and runs, odd rows, and the same in SQL."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, judge_turns, queries, scan_texts

SMALL = "/root/testdata/sf0.001"
GPL = "GNU General Public License\nversion 3"
ROWS = [
    (1, "a line\n\nCVE-1 told here\nsecurely", "en", "x"), (2, GPL, "de", "y"), (3, GPL, None, None), (None, None, "", "x"), (4, "", "en", "x"),
    (4, "", "en", "x"), (5, "ISC: Permission to use, copy, modify, and/or distribute", "a/b=c d", "x"), (6, "é" * 70_000, "en", "z"),
]


def documents(spark, rows):
    return spark.createDataFrame(rows, scan_texts.DOCUMENTS).withColumn("blob", F.lit("theirs")).withColumn("batch", F.lit(9)).withColumn("a.b", F.lit(1))


def contents(df, *without):
    return sorted(map(repr, df.drop(*without).collect()))


def test_scan_takes_what_is_new_only(spark, tmp_path):
    source, out, progress = (f"file://{tmp_path}/{x}" for x in ("in", "out", "progress"))
    documents(spark, ROWS[:4]).coalesce(1).write.parquet(source)
    assert scan_texts.run(spark, source, out, progress).count() == 4
    documents(spark, ROWS[4:] + ROWS[1:3]).coalesce(1).write.mode("append").parquet(source)
    both = scan_texts.run(spark, source, out, progress)
    assert sorted(map(str, (r["doc_id"] for r in both.collect()))) == sorted(str(r[0]) for r in ROWS + ROWS[1:3])
    scans = spark.read.parquet(f"{out}/scans")
    assert scans.count() == scans.select("blob").distinct().count() == 5  # the licence and the empty text were known
    assert {r["batch"]: r["count"] for r in scans.groupBy("batch").count().collect()} == {0: 3, 1: 2}
    before = contents(both)
    assert contents(scan_texts.run(spark, source, out, progress)) == before
    whole = scan_texts.run(spark, source, f"{out}-2", f"{progress}-2")
    assert contents(whole) == before
    found = {r["doc_id"]: r for r in whole.collect()}
    assert (found[1]["revealing"], found[1]["revealing_lines"], found[1]["lines"]) == (True, 2, 3)
    assert (found[3]["licence"], found[3]["status"], found[3]["language"], found[3]["lang"]) == ("GPL", "excluded", "none", None)
    assert (found[None]["chars"], found[None]["licence"], found[None]["language"]) == (0, None, "none")
    assert (found[5]["status"], found[5]["language"], found[6]["tokens"]) == ("confirm", "a/b=c d", 20_000)


def test_a_batch_that_is_repeated_replaces_itself(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    common.started(spark, f"{out}/scans", scan_texts.SCANS, "batch")
    common.started(spark, f"{out}/files", scan_texts.FILES, "language", "batch")
    for number, rows in ((0, ROWS[:5]), (1, ROWS[3:]), (1, ROWS[3:]), (0, ROWS[:5])):
        scan_texts.take(documents(spark, rows), number, out, [])
    assert scan_texts.report(spark, out).count() == 5 + len(ROWS[3:])
    assert spark.read.parquet(f"{out}/scans").groupBy("blob").count().where("count > 1").isEmpty()


def test_scan_settings_and_no_input(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    documents(spark, ROWS).coalesce(1).write.parquet(source)
    found = {r["doc_id"]: r for r in scan_texts.run(spark, source, out, f"{out}-p", {"never_scanned": ["de", "en"]}).collect()}
    assert found[1]["chars"] is None and found[2]["licence"] == found[3]["licence"] == "GPL"  # the same text in another language
    (tmp_path / "none").mkdir()
    assert scan_texts.run(spark, f"file://{tmp_path}/none", f"{out}-n", f"{out}-np").count() == 0
    with pytest.raises(ValueError, match="never_scaned"):
        scan_texts.run(spark, source, out, f"{out}-p", {"never_scaned": []})


def test_judging_replaces_listed_conditions_only(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    low, high = {"condition": "low", "threshold": 20}, {"condition": "high", "threshold": 400.0}
    first = contents(judge_turns.run(spark, SMALL, out, {"policies": [low, high]}))
    again = judge_turns.run(spark, SMALL, out, {"policies": [high]})
    assert contents(again) == first
    judge_turns.run(spark, SMALL, out, {"policies": [{"condition": "never"}]})
    more = judge_turns.run(spark, SMALL, out, {"policies": [low]})
    assert contents(more.where("condition <> 'never'")) == first
    totals = {r["condition"]: r for r in spark.read.parquet(f"{out}/summary").collect()}
    assert set(totals) == {"low", "high", "never"} and totals["never"]["blocked"] == totals["never"]["detected"] == 0
    assert totals["low"]["blocked"] >= totals["high"]["blocked"] and len({t["introduced"] for t in totals.values()}) == 1
    local = judge_turns.run(spark, SMALL, f"{out}-l", {"policies": [low], "scopes": ["local"]})
    assert {r[0] for r in local.select("scope").distinct().collect()} == {"local"}
    assert judge_turns.run(spark, SMALL, f"{out}-e", {"policies": [low], "scopes": ["nowhere"]}).count() == 0


@pytest.mark.parametrize("policies", [[], [{"condition": "a"}, {"condition": "a", "threshold": 1}], [{"condition": None}]])
def test_policies_must_be_listed_once(spark, tmp_path, policies):
    with pytest.raises(ValueError):
        judge_turns.run(spark, SMALL, f"file://{tmp_path}/out", {"policies": policies})


def test_configuration_files(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"policies": [{"condition": "A", "threshold": None}, {"condition": "B", "threshold": 2.5}]}, indent=1))
    assert common.config(spark, f"file://{path}")["policies"] == [{"condition": "A", "threshold": None}, {"condition": "B", "threshold": 2.5}]
    with pytest.raises(ValueError):
        common.checked({"other": 1}, {"policies": []})


@pytest.mark.parametrize("name", ["job1_scan_texts", "job2_judge_turns"])
def test_jobs_equal_sql(spark, name):
    got = queries.queries()[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    for view in ("documents", "events"):
        con.register(view, spark.read.parquet(f"{SMALL}/{view}.parquet").toArrow())
    expected = con.execute(queries.SQL[name]).df()[list(got.columns)]
    plain = lambda df: sorted(repr([None if v is None or v != v else v for v in row]) for row in df.astype(object).itertuples(index=False))
    assert plain(got) == plain(expected) and len(got)
