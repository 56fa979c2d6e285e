"""Helpers shared by the llm operators: reading tables, scratch tables in the
shared folder, cutting Arrow batches, and splitting texts into words without a
Python object per word."""

from __future__ import annotations

import ctypes
import os
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.session import scratch_path



def _reach_workers() -> None:
    """Python workers import this package by name. Where it is not installed
    but found beside the entry file, they get its folder in their path, both
    those of a running session and those of one started later."""
    root = str(Path(__file__).resolve().parents[2])
    paths = os.environ.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)
        running = SparkContext._active_spark_context
        if running is not None:
            running.environment.setdefault("PYTHONPATH", root)


_reach_workers()

#: Bytes of text that a task works on at once.
CHUNK_BYTES = 2 << 20


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts make large Arrow batches: fewer rows in one, unless the
    session has been given a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a parquet table in the shared folder: computed once, and
    safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_given_back(spark: SparkSession):
    """Executions in here give back their shuffle files when they end, not when
    the driver next collects garbage, which a small driver's heap may never
    call for. For tables that are written and then read from where they are.
    (Spark before 4.1 does not know the setting and waits for the garbage.)"""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts (one pass over that column)."""
    return int(df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0)


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES):
    """The batch in slices of about ``most`` bytes of text; a longer text is a
    slice of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The text column, null as empty, in one buffer that starts at 0."""
    return pa.concat_arrays([pc.fill_null(batch.column(text), "").cast(pa.large_string())])


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the texts (cut at blanks and ASCII control spaces),
    the index of every word in reading order, and the offsets of the texts in
    that order. An empty string may stand at either end of a text."""
    parts = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(parts.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    offsets = np.asarray(parts.offsets).astype(np.int64)
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), offsets - offsets[0]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i + 1]]`` for each i."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def give_back() -> None:
    """At the end of a task: free memory goes back to the system, since a
    worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def id_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64 (0 for null) and which of them are there."""
    there = np.asarray(pc.is_valid(column))
    return np.asarray(pc.fill_null(column, 0)).astype(np.int64), there
