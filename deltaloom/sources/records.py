"""Readers and writers of the file forms: turn records, labels, tidy tables, source trees, prompt pools, archives.

Schemas are stated, never inferred; a record of an unknown version is an error and not a guess.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One line of a trace file.
TRACE = (
    "schema_version int, trace_id string, seed int, turn int, kind string, timestamp string, files_after map<string,string>, diff string, "
    "changed_paths array<string>, prompt string, prompt_hash string, model string, response_text string, usage map<string,int>, latency_ms double, "
    "cached boolean, error string"
)
VERSIONS = (4, 5)
#: The tidy table: one row for each turn under each policy.
TIDY = (
    "trace_id string, event_id string, seed int, iteration int, condition string, vulnerability_class string, scope string, kind string, label string, basis string, "
    "role string, decision string, outcome string, items int, findings_introduced int, flags int, rules string, regression_present boolean, caught boolean, "
    "surviving boolean, scan_seconds double, graph_seconds double, triage_ms double, input_tokens int, output_tokens int, model_call boolean, cached boolean"
)
LABELS = (
    "schema_version int, event_id string, trace_sha256 string, scope string, regression_label string, injection_turn int, turns_by_label map<string,int>, turns_carried int, "
    "replications array<struct<seed:int,introduced_at:int,turns:array<struct<turn:int,kind:string,label:string,basis:string,introduced:boolean,injected:boolean>>>>"
)
SKIPPED_FOLDERS = (".git", "node_modules", "venv", ".venv", "__pycache__", "build", "dist")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a broken line or an unknown version fails the read."""
    rows = spark.read.schema(TRACE).option("mode", "FAILFAST").json(path)
    known = F.col("schema_version").isin(*VERSIONS)
    version = F.when(known, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("unknown record version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))).cast("int"))
    return rows.withColumn("schema_version", version)


def load_trace(spark: SparkSession, path: str) -> DataFrame:
    """A whole trace; one without records is an error, as it is a run that failed before it wrote anything."""
    rows = read_traces(spark, path)
    if rows.isEmpty():
        raise ValueError(f"no records in {path}")
    return rows


def file_hash(spark: SparkSession, path: str) -> str:
    """The sha256 of one file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def write_traces(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_tidy(spark: SparkSession, path: str) -> DataFrame:
    """Empty fields are nulls."""
    return spark.read.schema(TIDY).option("header", True).option("nullValue", "").csv(path)


def write_tidy(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("lineSep", "\n").csv(path)


def read_labels(spark: SparkSession, path: str, trace: str | None = None) -> DataFrame:
    """(event_id, seed, turn, kind, label, basis, introduced, injected): one row for each labelled turn. Labels of one ``trace`` file
    that were written for another version of it are refused."""
    rows = spark.read.schema(LABELS).option("multiLine", True).json(path)
    if trace is not None and (found := rows.select("trace_sha256").first()) and found[0] != file_hash(spark, trace):
        raise ValueError(f"{path} was written for another version of {trace}")
    rows = rows.select("event_id", "scope", F.explode("replications").alias("r"))
    return rows.select("event_id", "scope", F.col("r.seed").alias("seed"), F.explode("r.turns").alias("t")).select("event_id", "scope", "seed", "t.*")


def read_sources(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """(path, text) of a tree's files, without skipped folders, line ends as \\n; paths are relative to the tree."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    at = F.locate(folder.rstrip("/").removeprefix("file://"), F.col("path")) + len(folder.rstrip("/").removeprefix("file://")) + 1
    rows = rows.select(F.substring("path", at, F.length("path")).alias("path"), F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n").alias("text"))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in SKIPPED_FOLDERS])))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(number, prompt): lines of a prompt pool without blanks and comments; a repeated prompt is an error."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "prompt"))
    rows = rows.select("line", F.trim("prompt").alias("prompt")).where("prompt <> '' AND NOT prompt LIKE '#%'")
    times = F.count("*").over(Window.partitionBy("prompt"))
    checked = F.when(times > 1, F.raise_error(F.concat(F.lit("repeated prompt: "), "prompt")).cast("string")).otherwise(F.col("prompt"))
    return rows.select(F.row_number().over(Window.orderBy("line")).alias("number"), checked.alias("prompt"))


def read_zip_json(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, ordinal, json): the JSON members of zip archives in the order of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, name in enumerate(sorted(n for n in z.namelist() if n.endswith(".json"))):
                        yield pa.RecordBatch.from_pydict({"archive": [archive], "name": [name], "ordinal": pa.array([i], pa.int32()), "json": [z.read(name).decode()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, name string, ordinal int, json string")


def write_blobs(files: DataFrame, folder: str) -> None:
    """(state_id, path, text) as texts once by content, and an index."""
    rows = files.withColumn("blob", F.sha2("text", 256))
    rows.select("blob", "text").dropDuplicates(["blob"]).write.mode("overwrite").parquet(f"{folder}/blobs")
    rows.select("state_id", "path", "blob").write.mode("overwrite").parquet(f"{folder}/index")


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index").join(spark.read.parquet(f"{folder}/blobs"), "blob").select("state_id", "path", "text")


def parse_reply(reply: str, ids: set[str], labels: tuple[str, ...] = ("exploitable", "uncertain", "not-exploitable")) -> dict:
    """The verdicts of a reply: its outermost JSON object must name each id once with a known label; errors are values."""
    start, end = reply.find("{"), reply.rfind("}")
    if start < 0 or end < start:
        return {"error": "no object"}
    try:
        items = json.loads(reply[start : end + 1])["items"]
        found = [(str(i["id"]), i["label"]) for i in items]
    except (ValueError, KeyError, TypeError) as e:
        return {"error": f"unreadable: {type(e).__name__}"}
    if len({i for i, _ in found}) != len(found):
        return {"error": "repeated id"}
    if {i for i, _ in found} != ids:
        return {"error": "other ids"}
    if any(label not in labels for _, label in found):
        return {"error": "unknown label"}
    return {"labels": dict(found)}
