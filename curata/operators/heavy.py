"""The most frequent values of columns, exactly, where most values are distinct.

``groupBy(value).count()`` sends every distinct value, whole texts included,
over the network. Here values travel only where nothing smaller can settle the
matter; everything before works on their 64-bit hashes:

1. A mergeable frequent-items sketch of each column's hashes (Spark's
   ``approx_top_k``, a Misra-Gries summary of ``tracked`` entries) names
   candidates. One scan for all columns.
2. A second scan counts the candidates exactly and all other rows by ``buckets``
   hash buckets: at most ``tracked + buckets`` partial rows a column and task. A
   hash that is no candidate is at most as frequent as its bucket. Buckets below
   the k-th candidate's count therefore hold nothing that could still enter,
   whatever the sketch missed.
3. Only rows of the other buckets are counted by hash (8 bytes each). Where a value
   stands out none are left; where all are distinct all are, since no smaller
   message can tell that none repeats.
4. Values are looked up for the hashes that reach the k-th count. Where that
   count is 1, the others are the smallest values, taken without a shuffle.

Equal hashes of different values cannot change a result: a value is never more
frequent than its hash, values are counted as themselves at the end, and where the
k-th value then falls short of its hash's count, all values are counted.

Missing cells count as no value; an empty column has no top values; ties go to the
smaller value; a column with fewer than ``k`` values gives all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .quantiles import BROADCAST_ROWS, broadcast_if_small

TRACKED = 4096
BUCKETS = 16_384


@dataclass
class _Counts:
    """What is known of one column: exact counts by hash, buckets still open,
    and, once those are counted, how many hashes have each count."""
    by_hash: dict[int, int] = field(default_factory=dict)
    open_buckets: list[int] = field(default_factory=list)
    sizes: dict[int, int] = field(default_factory=dict)

    def kth(self, k: int) -> int:
        """Count of the k-th most frequent hash, 0 if there are fewer."""
        sizes = dict(self.sizes)
        for n in self.by_hash.values():
            sizes[n] = sizes.get(n, 0) + 1
        for n in sorted(sizes, reverse=True):
            k -= sizes[n]
            if k <= 0:
                return n
        return 0


def _hash(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = F.when(value == 0, F.lit(0.0).cast(dtype)).otherwise(value)     # -0.0 equals 0.0
    return F.when(value.isNotNull(), F.xxhash64(value))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int")


def top_values(df: DataFrame, columns: dict[str, Column], k: int = 1, tracked: int = TRACKED,
               buckets: int = BUCKETS) -> dict[str, list[tuple[object, int]]]:
    """Up to ``k`` (value, count) of each named column expression, by count
    descending and value ascending. Exact for every ``tracked`` and ``buckets``,
    which only bound the memory of the first two scans. The result, ``k`` values a
    column, comes to the driver."""
    if not columns:
        return {}
    if k < 1:
        return {c: [] for c in columns}
    tracked = max(tracked, k)
    values = df.select(*[x.alias(f"v{i}") for i, x in enumerate(columns.values())])
    hashes = values.select(*[_hash(F.col(f.name), f.dataType).alias(f.name) for f in values.schema])
    known = _first_counts(hashes, k, tracked, buckets)
    wide = _count_open(hashes, known, buckets)
    return {c: _resolve(values.select(F.col(f"v{i}").alias("value")), known[i], wide, i, k)
            for i, c in enumerate(columns)}


def _first_counts(hashes: DataFrame, k: int, tracked: int, buckets: int) -> list[_Counts]:
    spark = hashes.sparkSession
    names = hashes.columns
    # both kinds of missing sketch entries (no rows, missing cells) are left out
    seen = hashes.agg(*[F.expr(f"approx_top_k({v}, {tracked}, {tracked})").alias(v) for v in names]).first()
    candidates = [(i, e["item"]) for i, v in enumerate(names) for e in (seen[v] or []) if e["item"] is not None]
    marked = broadcast_if_small(spark.createDataFrame(candidates, "i int, h long"), len(candidates)).withColumn("known", F.lit(True))
    rows = _long(hashes).join(marked, ["i", "h"], "left")
    place = F.when(F.col("known"), F.col("h")).otherwise(_bucket(buckets).cast("long"))
    counted = rows.groupBy("i", F.col("known").isNotNull().alias("known"), place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    out = [_Counts() for _ in names]
    rest: list[dict[int, int]] = [{} for _ in names]
    for i, is_known, at, n in counted.collect():        # at most tracked + buckets rows a column
        (out[i].by_hash if is_known else rest[i])[at] = n
    for found, others in zip(out, rest):
        least = found.kth(k)
        found.open_buckets = [b for b, n in others.items() if n >= least]
    return out


def _long(hashes: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(v).alias("h")) for i, v in enumerate(hashes.columns)])
    return hashes.select(F.inline(cells)).where(F.col("h").isNotNull())


def _count_open(hashes: DataFrame, known: list[_Counts], buckets: int) -> DataFrame | None:
    """Counts of the hashes that are no candidates, in open buckets: ``i, h, n``."""
    if not any(c.open_buckets for c in known):
        return None
    spark = hashes.sparkSession
    wanted = [(i, b) for i, c in enumerate(known) for b in c.open_buckets]
    opened = broadcast_if_small(spark.createDataFrame(wanted, "i int, b int"), len(wanted))
    done = [(i, h) for i, c in enumerate(known) for h in c.by_hash]
    closed = broadcast_if_small(spark.createDataFrame(done, "i int, h long"), len(done))
    rows = _long(hashes).withColumn("b", _bucket(buckets)).join(opened, ["i", "b"], "left_semi").join(closed, ["i", "h"], "left_anti")
    wide = materialize(rows.groupBy("i", "h").agg(F.count(F.lit(1)).alias("n")), cut_lineage=True)
    for i, n, many in wide.groupBy("i", "n").agg(F.count(F.lit(1)).alias("many")).collect():
        known[i].sizes[n] = many            # one row for each count that occurs
    return wide


def _best(rows: DataFrame, k: int) -> list[tuple[object, int]]:
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return [(r["value"], r["n"]) for r in counts.orderBy(F.col("n").desc(), "value").limit(k).collect()]


def _resolve(values: DataFrame, known: _Counts, wide: DataFrame | None, i: int, k: int) -> list[tuple[object, int]]:
    spark = values.sparkSession
    values = values.where(F.col("value").isNotNull())
    rows = values.withColumn("h", _hash(F.col("value"), values.schema["value"].dataType))
    least = max(known.kth(k), 1)
    wanted = least + 1 if least == 1 else least
    many = sum(c for n, c in known.sizes.items() if n >= wanted)
    near = [(h,) for h, n in known.by_hash.items() if n >= wanted]
    if many + len(near) > BROADCAST_ROWS:
        return _best(values, k)             # that many tie: their values are counted themselves
    hit = spark.createDataFrame(near, "h long")
    if many:
        hit = hit.unionByName(wide.where((F.col("i") == i) & (F.col("n") >= wanted)).select("h"))
    hit = F.broadcast(hit)
    best = _best(rows.join(hit, "h", "left_semi"), k) if many or near else []
    if least == 1:
        # the other values occur once each: the smallest ones, k of them a task
        single = rows.join(hit, "h", "left_anti").select("value").orderBy("value").limit(k).collect()
        tail = [(r["value"], 1) for r in single]
        return _merged(best, tail)[:k]
    if len(best) < k or best[-1][1] < least:
        return _best(values, k)             # two values share a hash
    return best


def _merged(best: list, tail: list) -> list:
    """Both by count and value. Types order in Python as in Spark, but for texts,
    which go by their UTF-8 bytes, and NaN, which is the largest number."""
    def order(e):
        value = e[0].encode("utf-8") if isinstance(e[0], str) else e[0]
        return -e[1], value != value, value
    return sorted(best + tail, key=order)
