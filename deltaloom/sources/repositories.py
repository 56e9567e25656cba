"""Readers of repositories, rule sets, exclusions, specs and journals."""

from __future__ import annotations

import ast
import json
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPEC = (
    "event_id string, repo string, clean_commit string, regressed_commit string, vulnerability_class string, scope string, "
    "flow struct<entry:array<struct<symbol:string,kind:string,true_symbol:string>>,guards:array<struct<symbol:string>>,sinks:array<struct<symbol:string,kind:string,true_symbol:string>>>, "
    "regression_files array<string>"
)
# Classes that an event may have.
CLASSES = ("sql", "os-command", "command", "path-traversal")


def read_git_tree(spark: SparkSession, repo: str, commit: str, suffix: str = ".py") -> DataFrame:
    """(path, blob, text) of the files of a commit. Only names and hashes are listed on the driver; the texts are fetched
    by the tasks, one child process for each batch, from a repository that all executors see."""
    out = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "-z", commit], capture_output=True, check=True, text=True).stdout
    rows = [(path, meta.split()[2]) for meta, path in (x.split("\t", 1) for x in out.split("\0") if x) if path.endswith(suffix) and meta.split()[1] == "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("blob").to_pylist()
            data = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input=("\n".join(blobs) + "\n").encode(), capture_output=True, check=True).stdout
            texts, at = [], 0
            for _ in blobs:
                head_end = data.index(b"\n", at)
                size = int(data[at:head_end].split()[2])
                texts.append(data[head_end + 1 : head_end + 1 + size].decode("utf-8", "replace"))
                at = head_end + size + 2
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["path", "blob", "text"])

    return spark.createDataFrame(rows, "path string, blob string").mapInArrow(run, "path string, blob string, text string")


def file_at_commit(repo: str, commit: str, path: str) -> str | None:
    """One file's text at a commit, null if the commit doesn't have it; an unknown commit is an error."""
    subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "--quiet", f"{commit}^{{commit}}"], capture_output=True, check=True)
    out = subprocess.run(["git", "-C", repo, "cat-file", "blob", f"{commit}:{path}"], capture_output=True)
    return None if out.returncode else out.stdout.decode("utf-8", "replace")


def read_exclusions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Whole files (path) and single symbols (path, symbol) that are left out."""
    rows = spark.read.schema("exclusions array<struct<path:string,symbol:string,reason:string>>").option("multiLine", True).json(path).select(F.explode("exclusions").alias("e")).select("e.path", "e.symbol")
    return rows.where("symbol IS NULL").select("path").distinct(), rows.where("symbol IS NOT NULL").distinct()


def ruleset_hash(spark: SparkSession, folder: str, pattern: str = "*.y*ml") -> DataFrame:
    """(digest, files): one hash of a rule set: of every file, in the order of paths, its path, a zero, the hash of its text with
    plain line ends, and a line end. A rule set is small: its lines are put together in one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    prefix = folder.rstrip("/").removeprefix("file://") + "/"
    plain = F.encode(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")  # byte by byte
    rows = files.select(F.substring_index("path", prefix, -1).alias("path"), F.sha2(plain, 256).alias("sha"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: F.concat(x["path"], F.lit("\0"), x["sha"], F.lit("\n")))
    return rows.agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"), F.count("*").alias("files"))


def pinned_rules(spark: SparkSession, folder: str, manifest: str) -> str:
    """The digest of the rule set in ``folder``, which must be the one that the manifest pins; any other is refused."""
    pin = spark.read.schema("ruleset_sha256 string, rule_files long").option("multiLine", True).json(manifest).first()
    found = ruleset_hash(spark, folder).first()
    if pin is None or found["digest"] != pin["ruleset_sha256"]:
        raise ValueError(f"the rules in {folder} are not the set pinned in {manifest}: {found['files']} files found, {pin and pin['rule_files']} expected")
    return found["digest"]


def read_specs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Specs of events, and (event_id, problem) of those that can't be used."""
    rows = spark.read.schema(SPEC).option("multiLine", True).json(path)
    tests = [
        (F.col("event_id").isNull(), "no event_id"),
        (~F.coalesce(F.col("vulnerability_class").isin(*CLASSES), F.lit(False)), "unknown class"),
        (F.col("clean_commit").isNull() | F.col("regressed_commit").isNull(), "no commits"),
        (F.coalesce(F.size("flow.sinks"), F.lit(0)) == 0, "no sink"),
    ]
    problems = F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))
    rows = rows.withColumn("problems", problems)
    return rows.where(F.size("problems") == 0).drop("problems"), rows.select("event_id", F.explode("problems").alias("problem"))


def flow_scope(specs: DataFrame) -> DataFrame:
    """(event_id, files, scope): local if the whole flow is in one file; a guard outside the regression's files is an error."""
    file = lambda s: F.split_part(s, F.lit("::"), F.lit(1))
    ends = F.concat(F.transform("flow.entry", lambda x: file(F.coalesce(x["true_symbol"], x["symbol"]))), F.transform("flow.sinks", lambda x: file(F.coalesce(x["true_symbol"], x["symbol"]))))
    guards = F.transform("flow.guards", lambda x: file(x["symbol"]))
    stray = F.array_except(guards, "regression_files")
    files = F.array_sort(F.array_distinct(F.concat(ends, guards)))
    scope = F.when(F.size(stray) > 0, F.raise_error(F.concat(F.lit("guard outside the regression: "), stray[0])).cast("string")).when(F.size(files) == 1, "local").otherwise("cross_file")
    return specs.select("event_id", files.alias("files"), scope.alias("scope"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(line, payload): JSON text of each line's payload, which may also be written as a Python literal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("value").to_pylist():
                payload = None
                for read in (json.loads, ast.literal_eval):
                    try:
                        payload = json.dumps(read(text), sort_keys=True)
                        break
                    except (ValueError, SyntaxError):
                        continue
                out.append(payload)
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(out, pa.string())], names=["line", "payload"])

    return spark.read.text(path).where("trim(value) <> ''").mapInArrow(run, "line string, payload string")
