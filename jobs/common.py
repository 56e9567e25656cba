"""What the jobs share: configuration files, logs, tables that may not be there yet, the session of the command line."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def config(spark: SparkSession, path: str) -> dict:
    """A small JSON file as a dictionary; the path may be remote."""
    rows = spark.read.option("multiLine", True).json(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} must hold one JSON object")
    return rows[0].asDict(recursive=True)


def checked(found: dict, defaults: dict) -> dict:
    """Settings with defaults; an unknown one is an error, as it is a misspelt one more often than not."""
    if unknown := sorted(set(found) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | found


def started(spark: SparkSession, path: str, schema: str, *parts: str) -> None:
    """Make an empty table at ``path``, so that it can be read before anything was written; adds nothing to one that is there."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*parts).parquet(path)


def replaced(rows: DataFrame, path: str, *parts: str) -> None:
    """Write ``rows``; partitions that they have are replaced, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def command_line(description: str, *paths: str) -> tuple[SparkSession, argparse.Namespace]:
    parser = argparse.ArgumentParser(description=description)
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", required=True, help="a JSON file, see the one beside the job")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(description).getOrCreate(), args
