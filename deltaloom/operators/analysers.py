"""Reports of static analysers as findings, in DataFrame operations: parsing, identity, families, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cwe_numbers

RULE_REPORT = "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string,lines:string,metadata:struct<cwe:array<string>,confidence:string>>>>, paths struct<scanned:array<string>>"
CODE_REPORT = "results array<struct<test_id:string,filename:string,line_number:int,line_range:array<int>,issue_text:string,issue_severity:string,issue_confidence:string,issue_cwe:struct<id:int>,code:string>>"
# Severities of the first kind of report.
SEVERITIES = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
FINDING = ("tool", "rule_id", "cwes", "severity", "confidence", "path", "start_line", "end_line", "message", "code")


def severity(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return F.coalesce(table[F.upper(name)], F.when(F.lower(name).isin("low", "medium", "high"), F.lower(name)), F.lit("medium"))


def rule_findings(reports: DataFrame) -> DataFrame:
    """(key, json) of rule-based reports -> findings; a report that doesn't parse is an error."""
    parsed = F.from_json("json", RULE_REPORT, {"mode": "FAILFAST"})
    r = reports.select("key", parsed.alias("p")).select("key", F.explode("p.results").alias("r"))
    return r.select(
        "key", F.lit("rules").alias("tool"), F.col("r.check_id").alias("rule_id"), F.coalesce(cwe_numbers(F.col("r.extra.metadata.cwe")), F.expr("cast(array() as array<int>)")).alias("cwes"),
        severity(F.col("r.extra.severity")).alias("severity"), F.lower("r.extra.metadata.confidence").alias("confidence"), F.col("r.path").alias("path"), F.col("r.start.line").alias("start_line"),
        F.col("r.end.line").alias("end_line"), F.col("r.extra.message").alias("message"), F.col("r.extra.lines").alias("code"),
    )


def code_findings(reports: DataFrame) -> DataFrame:
    """(key, json) of reports with numbered tests -> findings."""
    r = reports.select("key", F.from_json("json", CODE_REPORT, {"mode": "FAILFAST"}).alias("p")).select("key", F.explode("p.results").alias("r"))
    return r.select(
        "key", F.lit("tests").alias("tool"), F.col("r.test_id").alias("rule_id"), F.array_compact(F.array("r.issue_cwe.id")).alias("cwes"), severity(F.col("r.issue_severity")).alias("severity"),
        F.lower("r.issue_confidence").alias("confidence"), F.col("r.filename").alias("path"), F.coalesce(F.array_min("r.line_range"), "r.line_number").alias("start_line"),
        F.coalesce(F.array_max("r.line_range"), "r.line_number").alias("end_line"), F.col("r.issue_text").alias("message"), F.col("r.code").alias("code"),
    )


def identity(finding: DataFrame) -> DataFrame:
    """Adds what makes two findings the same wherever they stand: tool, rule, path and code without white space."""
    return finding.withColumn("identity", F.struct("tool", "rule_id", "path", F.regexp_replace("code", r"(?U)\s+", "").alias("code")))


def of_family(findings: DataFrame, cwes: list[int]) -> DataFrame:
    return findings.where(F.arrays_overlap("cwes", F.array(*[F.lit(c) for c in cwes])))


def unscanned(files: DataFrame, reports: DataFrame) -> DataFrame:
    """(key, path) of files that no report says it has scanned."""
    scanned = reports.select("key", F.explode(F.from_json("json", RULE_REPORT)["paths"]["scanned"]).alias("path"))
    return files.select("key", "path").join(scanned, ["key", "path"], "left_anti")


def decision(items: Column, block_on: tuple[str, ...] = ("exploitable", "uncertain")) -> Column:
    """BLOCK if an item has a label of ``block_on``; an item without a label is untriaged and blocks; no item allows."""
    hit = F.exists(items, lambda i: i["label"].isNull() | i["label"].isin(*block_on))
    return F.when(F.coalesce(F.size(items), F.lit(0)) == 0, "ALLOW").when(hit, "BLOCK").otherwise("ALLOW")
