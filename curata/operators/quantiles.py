"""Exact, linearly interpolated quantiles that scale with the data.

Spark's ``percentile`` keeps every distinct value of a group in one buffer and
merges a group's buffers in one task, so a group holding a third of a 100 TB
table would not fit. Here each quantile is found by rank instead:

1. per group: ``n``, ``min``, ``max`` (partial aggregation, skew-safe);
2. each quantile ``p`` needs the values of rank ``floor((n-1)p)`` and
   ``ceil((n-1)p)`` (the numpy/pandas "linear" rule);
3. the first pass needs no statistics: values are counted per monotone
   "octave" bucket (binary exponent plus the top mantissa bits), in the same
   partial aggregate that yields the group's count, min and max (and, for
   summaries, sums and variances). Each wanted rank is located in its bucket.
   While an interval holds more than ``exact_limit`` rows it is cut into
   ``buckets`` equal-width buckets, counted with a partial aggregate, and the
   rank moves into the bucket that contains it (interval = that bucket's own
   min and max);
4. once an interval holds at most ``exact_limit`` rows its distinct values are
   counted and ranked with a window whose partition is that interval only.

Every pass over the data filters by the intervals (literals of the plan where
they are few, else a join with the interval table, broadcast under a checked
bound) and is followed by a partial aggregate, so no task ever sees more than
``exact_limit`` distinct values of one group and hot groups are split across
all map tasks. The result is exact; for doubles a handful of
passes suffice (each pass narrows an interval by ``buckets`` times).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import LITERAL_ROWS, materialize

DEFAULT_EXACT_LIMIT = 50_000
DEFAULT_BUCKETS = 4096
BROADCAST_ROWS = 200_000
MAX_ROUNDS = 64


def broadcast_if_small(df: DataFrame, rows_upper_bound: int,
                       limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count is known to be small; otherwise
    leave the join strategy to Catalyst / AQE (shuffle join, skew handling)."""
    return F.broadcast(df) if rows_upper_bound <= limit else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner", extra=None) -> DataFrame:
    """Equi-join on ``keys`` with NULL equal to NULL (group keys may be
    missing); ``extra(left_col, right_col)`` adds a non-equi condition."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    if extra is not None:
        e = extra(lambda n: left[n], lambda n: renamed[n])
        cond = e if cond is None else cond & e
    out = left.join(renamed, on=cond, how=how)
    return out.drop(*[f"__r_{k}" for k in keys])


def _rank_exprs(probs: Sequence[float]) -> Column:
    ranks = []
    for p in probs:
        h = (F.col("_n") - 1) * F.lit(float(p))
        ranks.append(F.floor(h).cast("long"))
        ranks.append(F.ceil(h).cast("long"))
    return F.array_distinct(F.array(*ranks))


def _in_intervals(data: DataFrame, tg: DataFrame, kn: list[str], n_tg: int) -> DataFrame:
    """Values inside the intervals (_a, _b) of their group."""
    iv = broadcast_if_small(tg.select(*kn, "_a", "_b").distinct(), n_tg)
    return null_safe_join(data, iv, kn,
                          extra=lambda l, r: (l("_v") >= r("_a")) & (l("_v") <= r("_b")))


def _hits(counted: DataFrame, tg: DataFrame, kn: list[str], n_tg: int, order: str) -> DataFrame:
    """Of rows counted (_c) in order within an interval, those that hold a
    wanted rank, with the number of rows before them (_lo)."""
    w = (Window.partitionBy(*kn, "_a", "_b").orderBy(order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = counted.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    want = broadcast_if_small(tg.select(*kn, "_a", "_b", "_r", "_rel"), n_tg)
    return null_safe_join(counted, want, kn + ["_a", "_b"],
                          extra=lambda l, r: (r("_rel") >= l("_lo")) & (r("_rel") < l("_hi")))


def _exact_pass(inside: DataFrame, tg: DataFrame, kn: list[str], n_tg: int) -> DataFrame:
    counted = inside.groupBy(*kn, "_a", "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    return _hits(counted, tg, kn, n_tg, "_v").select(*kn, "_r", F.col("_v").alias("_val"))


def _split_pass(inside: DataFrame, tg: DataFrame, kn: list[str], n_tg: int,
                buckets: int) -> DataFrame:
    # halves keep the width finite for values near the double range limits;
    # every step is monotone, so bucket order is value order
    half = F.lit(0.5)
    pos = (F.col("_v") * half - F.col("_a") * half) / (F.col("_b") * half - F.col("_a") * half)
    bucket = F.least(F.floor(pos * F.lit(float(buckets))), F.lit(buckets - 1)).cast("int")
    counted = (inside.groupBy(*kn, "_a", "_b", bucket.alias("_bk"))
               .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax")))
    hit = _hits(counted, tg, kn, n_tg, "_bk")
    return hit.select(*kn, "_r", F.col("_bmin").alias("_a"), F.col("_bmax").alias("_b"),
                      (F.col("_rel") - F.col("_lo")).alias("_rel"),
                      F.col("_c").alias("_cnt"))


OCTAVE_BITS = 8


def _pow2(e: Column) -> Column:
    """Exactly 2^e for an integer column e: integer shifts where they fit
    (cheap), ``pow`` only beyond 2^+-62."""
    one = F.lit(1).cast("long")

    def shl(k: Column) -> Column:          # shift amount is a column here
        return F.call_function("shiftleft", one, k.cast("int")).cast("double")
    return (F.when((e >= 0) & (e <= 62), shl(e))
            .when((e < 0) & (e >= -62), F.lit(1.0) / shl(-e))
            .otherwise(F.pow(F.lit(2.0), e)))


def with_octave_bucket(df: DataFrame, v: str = "_v", out: str = "_bk") -> DataFrame:
    """Add the monotone bucket id of the double ``v``: its binary exponent and
    the top ``OCTAVE_BITS`` bits of its mantissa (sign-mirrored for negatives,
    0 for zero, NULL for NULL).

    Exact: the exponent estimate from one ``ln`` is corrected by one where
    rounding put it off, powers of two are exact, and dividing by one is
    exact, so bucket order is value order. The steps are separate projections
    so that Catalyst keeps the one ``ln`` per row instead of inlining it into
    every branch that uses the exponent.
    """
    a = F.abs(F.col(v))
    est = F.floor(F.ln(a) * F.lit(1.4426950408889634))                       # 1 / ln(2)
    step1 = df.withColumn("__e0", F.least(F.greatest(est, F.lit(-1074)), F.lit(1023)))
    step2 = step1.withColumn("__p0", _pow2(F.col("__e0")))
    p0, e0 = F.col("__p0"), F.col("__e0")
    low, high = p0 > a, p0 * 2.0 <= a
    step3 = step2.select(
        "*", F.when(low, e0 - 1).when(high, e0 + 1).otherwise(e0).alias("__e"),
        F.when(low, p0 * 0.5).when(high, p0 * 2.0).otherwise(p0).alias("__p"))
    sub = F.floor((a / F.col("__p") - 1.0) * float(1 << OCTAVE_BITS))
    mag = (F.col("__e") + 1100) * (1 << OCTAVE_BITS) + sub + 1
    val = F.col(v)
    bucket = F.when(val == 0, F.lit(0)).when(val > 0, mag).otherwise(-mag).cast("long")
    return step3.withColumn(out, bucket).drop("__e0", "__p0", "__e", "__p")


def octave_histogram(projected: DataFrame, kn: list[str], moments: bool) -> DataFrame:
    """One partial aggregate per (group, octave bucket): count, min, max and,
    for summaries, sum and population variance. Rows whose value is missing
    land in a NULL bucket with count 0, so every group appears."""
    aggs = [F.count("_v").alias("_c"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax")]
    if moments:
        aggs += [F.sum("_v").alias("_s"), F.var_pop("_v").alias("_vp")]
    return with_octave_bucket(projected).groupBy(*kn, "_bk").agg(*aggs)


def moments_from_histogram(hist: DataFrame, kn: list[str], extra: Sequence[Column] = ()) -> DataFrame:
    """count, min, max, mean and sample sd per group, merged from the bucket
    table with the parallel-variance rule (stable, no sum of squares); ``extra``
    aggregates ride along."""
    g = Window.partitionBy(*kn)
    mean = F.try_divide(F.sum("_s").over(g), F.sum("_c").over(g))
    with_mean = hist.withColumn("_mean", mean)
    dev = F.try_divide(F.col("_s"), F.col("_c")) - F.col("_mean")
    m2 = F.when(F.col("_c") > 0, F.col("_vp") * F.col("_c") + F.col("_c") * dev * dev)
    agg = with_mean.groupBy(*kn).agg(
        F.sum("_c").alias("count"), F.min("_bmin").alias("min"), F.max("_bmax").alias("max"),
        F.first("_mean", ignorenulls=True).alias("mean"), F.sum(m2).alias("_m2"), *extra)
    sd = F.when(F.col("count") > 1, F.sqrt(F.try_divide(F.col("_m2"), F.col("count") - 1)))
    kept = [c for c in agg.columns if c not in (*kn, "count", "min", "max", "mean", "_m2")]
    return agg.select(*kn, "count", "min", "max", "mean", sd.alias("sd"), *kept)


def _with_ranks(hist: DataFrame, kn: list[str], probs: Sequence[float]) -> DataFrame:
    """The bucket table with, for each bucket, the wanted ranks that it holds
    (``_want``: structs _r, _a, _b, _rel, _cnt), from windows over one group's
    buckets alone."""
    g = Window.partitionBy(*kn)
    w = g.orderBy(F.col("_bk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.select("*", F.sum("_c").over(w).alias("_hi"), F.sum("_c").over(g).alias("_n"))
    lo = F.col("_hi") - F.col("_c")
    held = F.filter(_rank_exprs(probs), lambda r: (r >= lo) & (r < F.col("_hi")))
    want = F.transform(held, lambda r: F.struct(
        r.alias("_r"), F.col("_bmin").alias("_a"), F.col("_bmax").alias("_b"), (r - lo).alias("_rel"), F.col("_c").alias("_cnt")))
    return h.withColumn("_want", want)


def _intervals_as_literals(data: DataFrame, kn: list[str], intervals: list[tuple]) -> DataFrame:
    """Values inside few intervals (keys, a, b): the limits are literals, so
    only candidate rows leave the scan's stage."""
    kinds = {f.name: f.dataType for f in data.schema.fields}
    place = F
    for i, (*keys, a, b) in enumerate(intervals):
        hit = (F.col("_v") >= F.lit(a)) & (F.col("_v") <= F.lit(b))
        for k, v in zip(kn, keys):
            hit = hit & F.col(k).eqNullSafe(F.lit(v).cast(kinds[k]))
        place = place.when(hit, F.lit(i))
    limits = F.array(*[F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b")) for *_, a, b in intervals])
    found = data.withColumn("_i", place).where(F.col("_i").isNotNull())
    return found.select(*kn, "_v", F.get(limits, F.col("_i")).alias("_ab")).select(*kn, "_v", "_ab._a", "_ab._b")


def _find_ranks(data: DataFrame, kn: list[str], wanted: list[dict], exact_limit: int, buckets: int,
                literal_intervals: int) -> dict[tuple, dict[int, float]]:
    """The value at each wanted rank of each group, by driver-held intervals."""
    spark = data.sparkSession
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.schema.fields if f.name in kn)
    schema = ", ".join(x for x in (kinds, "_r long, _a double, _b double, _rel long, _cnt long") if x)
    found: dict[tuple, dict[int, float]] = {}

    def key(row) -> tuple:
        return tuple(row[k] for k in kn)

    for _ in range(MAX_ROUNDS):
        open_ = []
        for t in wanted:
            if t["_a"] == t["_b"]:
                found.setdefault(key(t), {})[t["_r"]] = t["_a"]
            else:
                open_.append(t)
        if not open_:
            return found
        wanted = []
        for part, one_pass in (([t for t in open_ if t["_cnt"] <= exact_limit], _exact_pass),
                               ([t for t in open_ if t["_cnt"] > exact_limit], _split_pass)):
            if not part:
                continue
            intervals = list(dict.fromkeys((*key(t), t["_a"], t["_b"]) for t in part))
            tg = spark.createDataFrame([tuple(t[c] for c in (*kn, "_r", "_a", "_b", "_rel", "_cnt")) for t in part], schema)
            if len(intervals) <= literal_intervals:
                inside = _intervals_as_literals(data, kn, intervals)
            else:
                inside = _in_intervals(data, tg, kn, len(part))
            if one_pass is _exact_pass:
                for r in _exact_pass(inside, tg, kn, len(part)).collect():
                    found.setdefault(key(r), {})[r["_r"]] = r["_val"]
            else:
                wanted += [r.asDict() for r in _split_pass(inside, tg, kn, len(part), buckets).collect()]
    raise RuntimeError("exact_quantiles did not converge")


def _find_ranks_of_many(data: DataFrame, active: DataFrame, kn: list[str], exact_limit: int, buckets: int) -> DataFrame:
    """The same for more groups than the driver should hold: every round's
    intervals are a written table. Returns keys, _r, _val."""
    found: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        active = materialize(active, cut_lineage=True)
        same = F.col("_a") == F.col("_b")
        c = active.agg(F.count(F.lit(1)), F.count_if(~same & (F.col("_cnt") <= exact_limit)),
                       F.count_if(~same & (F.col("_cnt") > exact_limit))).first()
        hits = active.where(same).select(*kn, "_r", F.col("_a").alias("_val"))
        if c[1]:
            small = active.where(~same & (F.col("_cnt") <= exact_limit))
            hits = hits.unionByName(_exact_pass(_in_intervals(data, small, kn, c[1]), small, kn, c[1]))
        found = hits if found is None else found.unionByName(hits)
        if not c[2]:
            return found
        big = active.where(~same & (F.col("_cnt") > exact_limit))
        active = _split_pass(_in_intervals(data, big, kn, c[2]), big, kn, c[2], buckets)
    raise RuntimeError("exact_quantiles did not converge")


def _quantile_columns(probs: Sequence[float], names: Sequence[str], n: Column) -> list[Column]:
    """Linear interpolation between the closest ranks, values in the map _m."""
    out = []
    for p, name in zip(probs, names):
        h = (n - 1) * F.lit(float(p))
        lo, hi = F.floor(h).cast("long"), F.ceil(h).cast("long")
        vlo, vhi = F.try_element_at(F.col("_m"), lo), F.try_element_at(F.col("_m"), hi)
        out.append(F.when(n > 0, vlo + (vhi - vlo) * (h - lo)).alias(name))
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column,
                    probs: Sequence[float], names: Sequence[str] | None = None,
                    moments: bool = False,
                    exact_limit: int = DEFAULT_EXACT_LIMIT,
                    buckets: int = DEFAULT_BUCKETS,
                    driver_groups: int = LITERAL_ROWS,
                    literal_intervals: int = 48) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys`` (linear interpolation between
    closest ranks, as numpy/pandas/DuckDB ``quantile_cont``).

    Missing and NaN values are ignored; a group without values gets NULLs.
    Returns ``keys`` plus one double column per probability (named ``names``
    or ``q0, q1, ...``); with ``moments`` also ``count, min, max, mean, sd``
    (sample sd) from the same first pass.

    One job makes the bucket table and returns, for up to ``driver_groups``
    groups, their moments and the intervals of their wanted ranks; one more
    finds the values (few intervals are literals of its plan). The result of
    few groups is a small local table and nothing stays cached. More groups
    take the same steps on written tables.
    """
    keys = list(keys)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    kn = [f"_k{i}" for i in range(len(keys))]
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    projected = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, kn)],
                          F.nanvl(v, F.lit(None).cast("double")).alias("_v"))
    data = projected.where(F.col("_v").isNotNull())
    ranked = _with_ranks(octave_histogram(projected, kn, moments), kn, probs)
    want = F.flatten(F.collect_list("_want")).alias("_want")
    if moments:
        base = moments_from_histogram(ranked, kn, [want])
        stats, n = ["count", "min", "max", "mean", "sd"], F.col("count")
    else:
        base = ranked.groupBy(*kn).agg(F.sum("_c").alias("_n"), want)
        stats, n = ["_n"], F.col("_n")
    rows = base.limit(driver_groups + 1).collect()
    if len(rows) <= driver_groups:
        wanted = [{**{k: r[k] for k in kn}, **t.asDict()} for r in rows for t in r["_want"]]
        values = _find_ranks(data, kn, wanted, exact_limit, buckets, literal_intervals)
        local = [(*(r[c] for c in (*kn, *stats)), values.get(tuple(r[k] for k in kn), {})) for r in rows]
        schema = T.StructType([base.schema[c] for c in (*kn, *stats)]).add("_m", T.MapType(T.LongType(), T.DoubleType()))
        out = df.sparkSession.createDataFrame(local, schema)
    else:
        base = materialize(base, cut_lineage=True)
        active = base.select(*kn, F.inline("_want"))
        found = _find_ranks_of_many(data, active, kn, exact_limit, buckets)
        per_group = found.groupBy(*kn).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_val"))).alias("_m"))
        out = null_safe_join(base.drop("_want"), per_group, kn, how="left")
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, kn)], *[c for c in stats if c != "_n"],
                      *_quantile_columns(probs, names, n))
