"""Helpers shared by the training-data operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither blanks nor tab .. carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: ASCII lower-casing, and only that.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Text that one step of a Python worker takes at once, so that its lists of words stay small.
STEP_CHARS = 1_500_000
#: The same where every byte of the step becomes several 8-byte numbers.
SMALL_STEP = 400_000


#: Intermediate tables of this session, for ``clean``.
WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one only where all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="deltaloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def clean(spark: SparkSession) -> None:
    """Delete what the operators wrote to the shared folder in this session; call it when their results have been consumed."""
    for path in WRITTEN:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    WRITTEN.clear()


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of text, one row at least."""
    sizes = [0 if n is None else n for n in pc.binary_length(batch.column(text)).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def released() -> None:
    """Give freed memory back to the system: workers stay when their tasks have ended, and so would what they freed."""
    gc.collect()
    trimmed()


def trimmed() -> None:
    """The same for what isn't held in cycles; cheap enough for every step."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, text: str = "text", most: int = STEP_CHARS) -> DataFrame:
    """``mapInArrow`` in bounded steps; ``make`` runs once in each task and returns the function of a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        gc.disable()  # large dictionaries of small objects and no cycles: walking them costs more than the work itself
        try:
            for batch in batches:
                for part in steps(batch, text, most):
                    if (out := step(part)) is not None and out.num_rows:
                        yield out
        finally:
            gc.enable()
            del step
            released()

    return df.mapInArrow(run, schema)


def meet(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key at most. Rows of ``hot`` keys stay where they are.

    ``hot``: a condition on ``table`` that few of its rows can meet, such as a count above a share of all rows; those are
    broadcast. Both sides should be written tables, since they are read twice.
    """
    few = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti").join(table.where(~hot).hint("merge"), keys)
    return rows.join(few, keys).unionByName(rest)
