"""Incremental scan of texts: what is new since the last run gets its licence, size and revealing words.

    python -m jobs.scan_texts --input 'DIR/documents.parque[t]' --output DIR --checkpoint DIR --config jobs/scan_texts.json

The input is a stream of Parquet files of ``documents``: those that the checkpoint hasn't seen are taken, and the run ends with
them. Two tables come out:

- ``files`` (doc_id, lang, source, blob, batch, language): a row for each row of the input, by language and batch;
- ``scans`` (blob, chars, tokens, lines, licence, status, revealing, revealing_lines, batch): a row for each distinct text, made
  once. A text that an earlier batch has scanned isn't scanned again, and copies within a batch are one before they meet.

A batch writes partitions of its own number and asks other batches' scans only. A batch that is repeated after a failure
therefore finds what it found the first time and replaces its own partitions, so both tables come out the same.

Settings: ``max_files`` a batch; ``never_scanned``: languages whose texts are listed but not scanned.

Defined results: a null text is an empty one; a language that is null or empty is filed under ``none``, its value stays in
``lang``; rows that repeat stay as many; columns that aren't read may have any name; no input files give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions import text as tx
from deltaloom.operators.states import hits_and_misses
from deltaloom.streaming.turn_state import upsert_each_batch

from .common import checked, command_line, config, log, replaced, started

DOCUMENTS = "doc_id long, text string, lang string, source string"
FILES = "doc_id long, lang string, source string, blob string, language string, batch long"
SCANS = "blob string, chars long, tokens long, lines long, licence string, status string, revealing boolean, revealing_lines long, batch long"
DEFAULTS = {"max_files": 1_000, "never_scanned": []}


def scanned(texts: DataFrame) -> DataFrame:
    """(blob, text) -> a row of SCANS but for the batch."""
    text, licence = F.col("text"), tx.licence_family(F.col("text"))
    told = F.filter(F.split(text, "\n"), lambda line: tx.is_revealing(line))
    return texts.select(
        "blob", F.length(text).cast("long").alias("chars"), tx.approx_tokens(text).alias("tokens"), tx.filled_lines(text).cast("long").alias("lines"), licence.alias("licence"),
        F.when(licence.isNotNull(), tx.licence_status(licence)).alias("status"), tx.is_revealing(text).alias("revealing"), F.size(told).cast("long").alias("revealing_lines"),
    )


def take(batch: DataFrame, number: int, output: str, never: list[str]) -> None:
    """One batch of documents: new texts are scanned, all rows are filed."""
    spark = batch.sparkSession
    seen = Observation("seen")
    language = F.when(F.coalesce("lang", F.lit("")) == "", "none").otherwise(F.col("lang"))
    rows = batch.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source").withColumn("blob", F.sha2("text", 256))
    wanted = rows.where(~F.coalesce(F.col("lang").isin(*never), F.lit(False))) if never else rows
    texts = wanted.groupBy("blob").agg(F.any_value("text").alias("text"))  # copies meet as one from each task
    known = spark.read.schema(SCANS).parquet(f"{output}/scans").where(F.col("batch") != number)
    _, misses = hits_and_misses(texts, known, ["blob"])
    made = Observation("made")
    fresh = scanned(texts.join(misses, "blob")).withColumn("batch", F.lit(number).cast("long")).observe(made, F.count("*").alias("n"))
    replaced(fresh, f"{output}/scans", "batch")
    filed = rows.select("doc_id", "lang", "source", "blob", language.alias("language"), F.lit(number).cast("long").alias("batch"))
    replaced(filed.observe(seen, F.count("*").alias("n")), f"{output}/files", "language", "batch")
    log.info("batch %d: read %d rows, wrote %d scans to %s/scans and %d rows to %s/files", number, seen.get["n"], made.get["n"], output, seen.get["n"], output)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """Take what is new in ``source``, a folder or a pattern of files, and return the whole output so far."""
    s = checked(settings or {}, DEFAULTS)
    output = output.rstrip("/")
    started(spark, f"{output}/scans", SCANS, "batch")
    started(spark, f"{output}/files", FILES, "language", "batch")
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", s["max_files"]).parquet(source)
    query = upsert_each_batch(stream, lambda batch, number: take(batch, number, output, list(s["never_scanned"])), checkpoint)
    query.awaitTermination()
    return report(spark, output)


def report(spark: SparkSession, output: str) -> DataFrame:
    """Every filed row with the scan of its text, nulls where it has none."""
    files, scans = spark.read.schema(FILES).parquet(f"{output}/files"), spark.read.schema(SCANS).parquet(f"{output}/scans")
    return files.drop("batch").join(scans.drop("batch"), "blob", "left")


def main() -> None:
    spark, args = command_line("scan_texts", "input", "output", "checkpoint")
    try:
        log.info("output: %d rows", run(spark, args.input, args.output, args.checkpoint, config(spark, args.config)).count())
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
