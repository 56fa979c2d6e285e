"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of their keys. A four-round Feistel
network over the smallest even number of bits that holds n permutes the
numbers; a result outside 0..n-1 goes through the network again until it falls
inside (cycle walking), which keeps it a permutation. The permuted number p
gives shard ``p mod n_shards`` and slot ``p div n_shards``, so shard sizes
differ by one row at most, slots have no gap, and :func:`place` and
:func:`row_at` compute either direction for one row without the table.

Law: ``rows`` (counts at most one apart). A shard is decided by the row number
alone, so equal texts are spread like any other rows.

Edge cases: null keys come first in the order; rows equal in all keys take
neighbouring numbers in any order (they are interchangeable); an empty table
gives an empty result; columns of the input named row_number, shard or slot
are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.common import partitions, written

ROUNDS = 4
_PID, _TIE = "_curata_pid", "_curata_tie"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """Round function: the splitmix64 finaliser of the half block and a round key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % 2**64 for i in range(ROUNDS)]


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    half = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(half)) - 1)
    left, right = x >> half, x & mask
    for key in reversed(_keys(seed)) if back else _keys(seed):
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << half) | right


def permute(rows: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at ``rows``."""
    with np.errstate(over="ignore"):
        x = _network(np.asarray(rows).astype(np.uint64), n, seed, back)
        while (out := x >= np.uint64(n)).any():
            x[out] = _network(x[out], n, seed, back)
    return x.astype(np.int64)


def place(row: int, n: int, n_shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % n_shards, p // n_shards


def row_at(shard: int, slot: int, n: int, n_shards: int, seed: int = 0) -> int:
    """Row number that lies at a shard's slot."""
    return int(permute(np.array([slot * n_shards + shard]), n, seed, back=True)[0])


def number_rows(df: DataFrame, keys: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """The rows with their place (from 0) in the order of ``keys``, and how many.

    Rows are dealt to ranges of the keys; the last key is a tie-breaker of the
    scan, so rows that share all keys are dealt to many ranges too. Only one
    count per range reaches the driver."""
    spark = df.sparkSession
    ranged = df.drop(name).withColumn(_TIE, F.monotonically_increasing_id())
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.col(_TIE)]
    ranged = ranged.repartitionByRange(partitions(spark), *order).withColumn(_PID, F.spark_partition_id())
    ranged = written(ranged, "ranges")
    counts = sorted((r[_PID], r["count"]) for r in ranged.groupBy(_PID).count().collect())
    starts, total = [], 0
    for pid, count in counts:
        starts.append((pid, total))
        total += count
    offsets = spark.createDataFrame(starts or [(0, 0)], f"{_PID} int, _curata_start long")
    inside = F.row_number().over(Window.partitionBy(_PID).orderBy(*order)).cast("long")
    numbered = ranged.withColumn(name, inside - 1).join(F.broadcast(offsets), _PID)  # one row per range
    return numbered.withColumn(name, F.col(name) + F.col("_curata_start")).drop(_PID, _TIE, "_curata_start"), total


def shard_rows(df: DataFrame, keys: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """The rows with ``row_number``, ``shard`` and ``slot``."""
    numbered, n = number_rows(df.drop("shard", "slot"), keys)

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return (numbered.withColumn("slot", permuted("row_number"))
            .withColumn("shard", F.pmod("slot", F.lit(n_shards)).cast("int"))
            .withColumn("slot", F.floor(F.col("slot") / n_shards).cast("long")))


def write_shards(df: DataFrame, path: str, keys: list[str], n_shards: int, seed: int = 0) -> None:
    """Parquet with one folder per shard, each sorted by slot."""
    rows = shard_rows(df, keys, n_shards, seed)
    (rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 0) -> DataFrame:
    """Place of every document: doc_id, size (UTF-8 bytes of the text, null as
    none, plus 16), text_crc32, law, shard, slot, grown_shard (null: only the
    ``key`` law has one) and row_number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select(F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = shard_rows(digest, ["doc_id", "text_crc32", "size"], n_shards, seed)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "row_number")
