"""The numbers behind the reference's plots, as small DataFrames: histogram,
kernel density, box statistics, bar counts, line series.

Ranges and group statistics enter the plan as scalar subqueries or joins with
per-group tables (broadcast only under a checked row bound), so nothing is
collected to the driver and every heavy step is a partial aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import roles
from ..functions.exprs import clean_numeric, label_missing, parse_datetime, zero_sign
from ..session import kept_rows
from .quantiles import BROADCAST_ROWS, exact_quantiles, null_safe_join

DEFAULT_BINS = 30


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _group_label(df: DataFrame, group_by: str | None) -> Column:
    if not group_by or group_by not in df.columns:
        return F.lit(None).cast("string")
    return label_missing(_q(group_by), df.schema[group_by].dataType)


def _named(df: DataFrame, group_by: str | None, grouped: bool) -> DataFrame:
    """The group column under its own name, or ``<name>_group`` where a result
    column is called like it; without a group it goes."""
    if not grouped:
        return df.drop("_g")
    name = f"{group_by}_group" if group_by.lower() in {c.lower() for c in df.columns} else group_by
    return df.withColumnRenamed("_g", name).orderBy(_q(name), *[c for c in ("bin", "point") if c in df.columns])


def _edges(lo: float | None, hi: float | None) -> tuple[float, float]:
    """Outer edges: no value gives 0 to 1, one value half a unit either side."""
    if lo is None:
        return 0.0, 1.0
    return (lo - 0.5, hi + 0.5) if lo == hi else (float(lo), float(hi))


def _edge(i: Column, ends: tuple[float, float], bins: int) -> Column:
    step = (ends[1] - ends[0]) / bins
    return F.when(i == bins, F.lit(ends[1])).otherwise(i.cast("double") * F.lit(step) + F.lit(ends[0]))


def _bin_of(x: Column, ends: tuple[float, float], bins: int) -> Column:
    """Place of a value among equal bins, the last one closed. The quotient may
    round to a neighbour, so it is compared with the bin's own two edges."""
    near = F.least(F.greatest(F.floor((x - F.lit(ends[0])) / F.lit(ends[1] - ends[0]) * F.lit(float(bins))), F.lit(0)), F.lit(bins - 1)).cast("int")
    down = (x < _edge(near, ends, bins)) & (near > 0)
    up = (x >= _edge(near + 1, ends, bins)) & (near < bins - 1)
    return F.when(down, near - 1).when(up, near + 1).otherwise(near)


def _all_bins(counted: DataFrame, keys: list[str], ends: tuple[float, float], bins: int) -> DataFrame:
    """Bin rows, empty ones too, of ``counted`` (keys, bin, n): a group's bins
    are a map of at most ``bins`` entries."""
    entries = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))))
    each = counted.groupBy(*keys).agg(entries.alias("_m")) if keys else counted.agg(entries.alias("_m"))
    rows = each.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return rows.select(*keys, "bin", zero_sign(_edge(F.col("bin"), ends, bins)).alias("bin_lo"),
                       zero_sign(_edge(F.col("bin") + 1, ends, bins)).alias("bin_hi"),
                       F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).cast("long").alias("count"))


def histogram(df: DataFrame, column: str, bins: int = DEFAULT_BINS,
              group_by: str | None = None) -> DataFrame:
    """Equal-width counts over the non-missing values (edges shared by all
    groups; a constant column is widened by 0.5 each side; the last bin is
    closed). Empty bins are listed with count 0, also of a column without
    values. Columns: ``[group,] bin, bin_lo, bin_hi, count``. One pass over
    the data after the range."""
    bins = max(int(bins or DEFAULT_BINS), 1)
    grouped = bool(group_by and group_by in df.columns)
    base = df.select(clean_numeric(df, column).alias("_x"), _group_label(df, group_by).alias("_g")).where(F.col("_x").isNotNull())
    # fit: the edges are one row of two numbers, used as literals afterwards
    r = base.agg(F.min("_x"), F.max("_x")).first()
    ends = _edges(r[0], r[1])
    counted = base.groupBy("_g", _bin_of(F.col("_x"), ends, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = _all_bins(counted, ["_g"] if grouped else [], ends, bins)
    return _named(out, group_by, True) if grouped else out.orderBy("bin")


def histograms(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """The histograms of several number columns: ``variable, bin, bin_lo,
    bin_hi, count``. One job finds all ranges, one pass counts all bins."""
    cells = {c: clean_numeric(df, c) for c in columns}
    r = df.agg(*[f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(cells.values()) for f in (F.min, F.max)]).first()
    ends = {c: _edges(r[f"min{i}"], r[f"max{i}"]) for i, c in enumerate(columns)}
    # a number for each bin of each column; all of them meet in one map of columns x bins entries
    places = F.array(*[F.when(x.isNotNull(), _bin_of(x, ends[c], bins) + F.lit(i * bins)) for i, (c, x) in enumerate(cells.items())])
    counted = df.select(F.explode(places).alias("place")).where(F.col("place").isNotNull()).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    counts = counted.agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("_m"))

    def bins_of(i: int, c: str):
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(
            F.lit(c).alias("variable"), b.alias("bin"), zero_sign(_edge(b, ends[c], bins)).alias("bin_lo"), zero_sign(_edge(b + 1, ends[c], bins)).alias("bin_hi"),
            F.coalesce(F.try_element_at("_m", b + F.lit(i * bins)), F.lit(0)).cast("long").alias("count")))

    rows = [bins_of(i, c) for i, c in enumerate(columns)]
    return counts.select(F.inline(F.flatten(F.array(*rows))))


def log2_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Histogram of log2 of the values; values <= 0 are left out."""
    x = clean_numeric(df, column)
    logged = df.select(F.when(x > 0, F.log2(x)).alias(f"{column}_log2"))
    return histogram(logged, f"{column}_log2", bins)


#: A Gaussian further from its centre than this many bandwidths is exactly 0 in doubles.
KERNEL_REACH = 38.7


#: Terms kept of a cell's series, and the width of a cell in bandwidths.
SERIES_TERMS = 12
CELL_WIDTH = 0.5
#: Kernels further away than this many bandwidths are below 1e-17 of their peak.
SERIES_REACH = 9.0


def series_error(terms: int = SERIES_TERMS, width: float = CELL_WIDTH) -> float:
    """Bound on what a row's kernel, with peak 1, loses by the cut series: a
    Hermite polynomial times its Gaussian is at most 1.0865 sqrt(p!) (Cramer),
    and a row is at most half a cell from the cell's middle."""
    t = width / 2
    return 1.0865 * sum(t ** p / math.sqrt(math.factorial(p)) for p in range(terms, terms + 40)) + math.exp(-SERIES_REACH ** 2 / 2)


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients by power of the first Hermite polynomials, each from its two predecessors."""
    rows = [[1], [0, 1]]
    for p in range(1, terms - 1):
        up, old = [0] + rows[p], rows[p - 1] + [0, 0]
        rows.append([a - p * b for a, b in zip(up, old)])
    return rows[:terms]


def _row_terms(j: DataFrame, step: Column, gridsize: int) -> DataFrame:
    """Kernel terms ``_g, point, _t`` of every (value, weight)."""
    reach = F.lit(KERNEL_REACH) * F.col("_bw")
    first = F.greatest(F.ceil((F.col("_x") - reach - F.col("_lo")) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("_x") + reach - F.col("_lo")) / step), F.lit(gridsize - 1)).cast("int")
    pts = j.select("_g", "_x", "_w", "_bw", "_lo", step.alias("_step"), F.explode(F.sequence(first, last)).alias("point"))
    z = (F.col("_lo") + F.col("point") * F.col("_step") - F.col("_x")) / F.col("_bw")
    return pts.select("_g", "point", (F.col("_w") * F.exp(F.lit(-0.5) * z * z)).alias("_t"))


def _cell_terms(j: DataFrame, step: Column, gridsize: int) -> DataFrame:
    """The same sums by a Gauss transform: with t and u the distances in bandwidths
    of a value and of a grid point from a cell's middle,
    ``exp(-(u - t)^2 / 2) = exp(-u^2 / 2) * sum of He_p(u) t^p / p!``. A row adds
    its powers of t to one cell; cells, not rows, meet grid points."""
    width = F.lit(CELL_WIDTH) * F.col("_bw")
    placed = j.withColumn("_c", F.floor((F.col("_x") - F.col("_lo")) / width))
    placed = placed.withColumn("_mid", F.col("_lo") + (F.col("_c") + F.lit(0.5)) * width).withColumn("_t1", (F.col("_x") - F.col("_mid")) / F.col("_bw"))
    power, sums = F.col("_w").cast("double"), []
    for p in range(SERIES_TERMS):
        sums.append(F.sum(power).alias(f"_m{p}"))
        power = power * F.col("_t1")
    cells = placed.groupBy("_g", "_bw", "_lo", step.alias("_step"), "_c", "_mid").agg(*sums)
    # moments to coefficients of a polynomial in u
    rows = _hermite(SERIES_TERMS)
    coefs = [sum((F.col(f"_m{p}") * F.lit(rows[p][power] / math.factorial(p)) for p in range(power, SERIES_TERMS) if rows[p][power]), F.lit(0.0)).alias(f"_b{power}")
             for power in range(SERIES_TERMS)]
    reach = F.lit(SERIES_REACH + CELL_WIDTH / 2) * F.col("_bw")
    first = F.greatest(F.ceil((F.col("_mid") - reach - F.col("_lo")) / F.col("_step")), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("_mid") + reach - F.col("_lo")) / F.col("_step")), F.lit(gridsize - 1)).cast("int")
    # a narrow kernel may lie between two grid points
    cells = cells.select("_g", "_bw", "_lo", "_step", "_mid", first.alias("_first"), last.alias("_last"), *coefs).where("_first <= _last")
    pts = cells.withColumn("point", F.explode(F.sequence("_first", "_last")))
    pts = pts.withColumn("_u", (F.col("_lo") + F.col("point") * F.col("_step") - F.col("_mid")) / F.col("_bw"))
    value = F.col(f"_b{SERIES_TERMS - 1}")
    for power in range(SERIES_TERMS - 2, -1, -1):
        value = value * F.col("_u") + F.col(f"_b{power}")
    return pts.select("_g", "point", (value * F.exp(F.lit(-0.5) * F.col("_u") * F.col("_u"))).alias("_t"))


def density(df: DataFrame, column: str, group_by: str | None = None, bw_adjust: float = 1.0,
            gridsize: int = 200, cut: float = 3.0,
            collapse: bool | None = None, series: bool = False) -> DataFrame:
    """Gaussian kernel density on a grid of ``gridsize`` points per group.

    Bandwidth is Scott's rule (sample sd x n^-1/5) times ``bw_adjust`` (at
    least 0.1); the grid runs ``cut`` bandwidths beyond the data; each group
    integrates to 1; groups with under 2 rows or zero variance have none.
    Where values repeat (estimated distinct values at most half the rows, from
    the same pass as the bandwidths) equal values are first collapsed to (value,
    weight), so each distinct value adds its kernel once, at the grid points
    where it is not 0 in doubles; for near-unique columns that collapse would
    shuffle the whole column for nothing, so each row adds its kernel directly
    in the map stage. ``collapse`` forces either path. Both are exact.

    With ``series`` a row adds 12 moments to one cell of half a bandwidth, and
    cells, not rows, meet grid points (see :func:`_cell_terms`), whatever
    repeats: for large near-unique columns. A density then differs by less
    than 1e-10 of a kernel's peak, 1 / (bandwidth sqrt(2 pi)), from the exact one
    (:func:`series_error`, below 1e-11, and rounding). Only sums per (group,
    cell) and (group, point) are shuffled.
    Columns: ``[group,] point, x, density``.
    """
    adjust = max(float(bw_adjust or 1.0), 0.1)
    grouped = bool(group_by and group_by in df.columns)
    base = df.select(clean_numeric(df, column).alias("_x"), _group_label(df, group_by).alias("_g")).where(F.col("_x").isNotNull())
    stats = (base.groupBy("_g")
             .agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"),
                  F.min("_x").alias("_mn"), F.max("_x").alias("_mx"),
                  F.approx_count_distinct("_x").alias("_ndv"))
             .where((F.col("_n") >= 2) & (F.col("_sd") > 0)))
    bw = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.lit(adjust)
    stats = stats.select("_g", "_n", "_ndv", bw.alias("_bw"),
                         (F.col("_mn") - F.lit(cut) * bw).alias("_lo"),
                         (F.col("_mx") + F.lit(cut) * bw).alias("_hi"))
    stats, groups = kept_rows(stats)
    if series:
        collapse = False
    if collapse is None:
        facts = stats.agg(F.sum("_n").alias("rows"), F.sum("_ndv").alias("ndv")).first()
        collapse = bool(groups) and facts["ndv"] * 2 <= facts["rows"]
    if collapse:
        weights = base.groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_w"))
    else:
        weights = base.select("_g", "_x", F.lit(1).cast("long").alias("_w"))
    small = F.broadcast(stats) if groups <= BROADCAST_ROWS else stats
    j = null_safe_join(weights, small.drop("_ndv"), ["_g"])
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(gridsize - 1))
    terms = (_cell_terms if series else _row_terms)(j, step, gridsize)
    sums = terms.groupBy("_g", "point").agg(F.sum("_t").alias("_s"))
    grid = small.select("_g", "_n", "_bw", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("point"))
    out = null_safe_join(grid, sums, ["_g", "point"], how="left")
    norm = F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi))
    out = out.select("_g", "point", zero_sign(F.col("_lo") + F.col("point") * step).alias("x"),
                     (F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(0.0)) / norm).alias("density"))
    return _named(out, group_by, True) if grouped else out.drop("_g").orderBy("point")


def _box_fences(base: DataFrame, whis: float) -> DataFrame:
    """Quartiles and fences of each group, sent to all tasks when they are few."""
    qs = exact_quantiles(base, ["_g"], "_y", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    fences = qs.select("_g", "q1", "median", "q3", (F.col("q1") - F.lit(whis) * iqr).alias("_lo"),
                       (F.col("q3") + F.lit(whis) * iqr).alias("_hi"))
    fences, groups = kept_rows(fences)
    return F.broadcast(fences) if groups <= BROADCAST_ROWS else fences


def _box_rows(df: DataFrame, y: str, x: str | None, whis: float) -> DataFrame:
    base = df.select(_group_label(df, x).alias("_g"), clean_numeric(df, y).alias("_y")).where(F.col("_y").isNotNull())
    return null_safe_join(base, _box_fences(base, whis), ["_g"])


def box_stats(df: DataFrame, y: str, x: str | None = None, whis: float = 1.5) -> DataFrame:
    """Per category of ``x`` (missing shown as ``(Missing)``): n, Q1, median,
    Q3, whiskers (furthest data within ``whis`` IQR of the box) and the number
    of outliers. Quantiles are exact; whiskers come from one aggregate over
    the data joined with the per-category fences."""
    grouped = bool(x and x in df.columns)
    rows = _box_rows(df, y, x, whis)
    inside = (F.col("_y") >= F.col("_lo")) & (F.col("_y") <= F.col("_hi"))
    agg = rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.min(F.when(inside, F.col("_y"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_y"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    out = agg.select("_g", "n", *[zero_sign(F.col(c)).alias(c) for c in
                                  ("q1", "median", "q3", "whisker_low", "whisker_high")],
                     "n_outliers")
    return _named(out, x, grouped)


def _points(rows: DataFrame, y: str, x: str | None, grouped: bool) -> DataFrame:
    if not grouped:
        return rows.select(F.col("_y").alias(y))
    return rows.select(F.col("_g").alias(x if x.lower() != y.lower() else f"{x}_group"), F.col("_y").alias(y))


def box_outliers(df: DataFrame, y: str, x: str | None = None, whis: float = 1.5) -> DataFrame:
    """The points drawn beyond the whiskers: ``[x,] y`` for every outlier."""
    rows = _box_rows(df, y, x, whis)
    return _points(rows.where((F.col("_y") < F.col("_lo")) | (F.col("_y") > F.col("_hi"))), y, x, bool(x and x in df.columns))


def bar_counts(df: DataFrame, x: str) -> DataFrame:
    """Rows per category (missing labelled), most frequent first."""
    if x not in df.columns or not roles.is_categorical(df, x):
        raise ValueError(f"{x!r} is not a categorical column")
    lab = label_missing(_q(x), df.schema[x].dataType).alias("category")
    return (df.groupBy(lab).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("category")))


#: Cells that decide whether a text column holds times, where an order is given.
FIRST_CELLS = 200


def is_datetime_like(df: DataFrame, column: str, threshold: float = 0.8, order_by: str | None = None) -> bool:
    """Timestamp/date columns, or text columns whose non-missing values parse
    as time at least ``threshold`` of the time: over all rows, or with
    ``order_by`` (a position from a reader) over the first 200 non-missing."""
    f = df.schema[column]
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return True
    if not isinstance(f.dataType, T.StringType):
        return False
    if order_by:
        df = df.where(_q(column).isNotNull()).orderBy(_q(order_by)).select(_q(column)).limit(FIRST_CELLS)
    r = df.agg(F.count(_q(column)).alias("n"),
               F.count(parse_datetime(_q(column))).alias("ok")).first()
    return bool(r["n"]) and r["ok"] / r["n"] >= threshold


def datetime_report(df: DataFrame, columns: Sequence[str] | None = None,
                    threshold: float = 0.8, order_by: str | None = None) -> DataFrame:
    """Per text or time column: non-missing cells, cells that parse as time,
    their share, and whether the column counts as date/time. One aggregate.
    With ``order_by`` only the first 200 non-missing cells of each column count;
    each task passes on 200 a column at most."""
    cols = [c for c in (columns or df.columns) if c in df.columns and isinstance(
        df.schema[c].dataType, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType))]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, non_missing bigint, parsed bigint, parsed_share double, is_datetime boolean")
    if order_by:
        cells = [F.struct(F.lit(i).alias("i"), _q(c).cast("string").alias("v"),
                          F.lit(not isinstance(df.schema[c].dataType, T.StringType)).alias("timed")) for i, c in enumerate(cols)]
        rows = df.select(_q(order_by).alias("at"), F.inline(F.array(*cells))).where("v is not null")
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("at"))).where(F.col("r") <= FIRST_CELLS)
        # one row a column, kept apart from the cells
        ok = F.when(F.col("timed"), True).otherwise(parse_datetime(F.col("v")).isNotNull())
        seen = rows.groupBy("i").agg(F.count(F.lit(1)).alias("non_missing"), F.count_if(ok).alias("parsed"))
        names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, column string")
        rows = names.join(seen, "i", "left").select("column", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("non_missing", "parsed")))
        return _report(rows, threshold)
    aggs = []
    for i, c in enumerate(cols):
        if isinstance(df.schema[c].dataType, T.StringType):
            ok = F.count(parse_datetime(_q(c)))
        else:
            ok = F.count(_q(c))
        aggs += [F.count(_q(c)).alias(f"n{i}"), ok.alias(f"p{i}")]
    one = df.agg(*aggs)
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_missing"),
                 F.col(f"p{i}").alias("parsed")) for i, c in enumerate(cols)])))
    return _report(rows, threshold)


def _report(rows: DataFrame, threshold: float) -> DataFrame:
    share = F.try_divide(F.col("parsed").cast("double"), F.col("non_missing"))
    return rows.select("column", "non_missing", "parsed", F.bround(share, 6).alias("parsed_share"),
                       F.coalesce(share >= F.lit(threshold), F.lit(False)).alias("is_datetime"))


def datetime_columns(df: DataFrame, threshold: float = 0.8, order_by: str | None = None) -> list[str]:
    """Columns that are date/time typed or date/time-like text (one aggregate
    for all text columns)."""
    rep = datetime_report(df, threshold=threshold, order_by=order_by).collect()        # one row per column
    like = {r["column"] for r in rep if r["is_datetime"]}
    return [c for c in df.columns if c in like]


def line_x_choices(df: DataFrame) -> list[str]:
    """Columns a line plot may use as x: date/time-like first, then numeric."""
    dts = datetime_columns(df)
    return dts + [c for c in roles.numeric_columns(df) if c not in dts]


def box_points(df: DataFrame, y: str, x: str | None = None) -> DataFrame:
    """The raw points drawn over a box plot: ``[x,] y`` of every non-missing y
    (missing categories labelled). All rows: nothing is sampled."""
    rows = df.select(_group_label(df, x).alias("_g"), clean_numeric(df, y).alias("_y")).where(F.col("_y").isNotNull())
    return _points(rows, y, x, bool(x and x in df.columns))


def coerce_datetime(df: DataFrame, column: str) -> Column:
    """The column as a timestamp when it is date/time-like, else unchanged."""
    f = df.schema[column]
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return _q(column)
    if is_datetime_like(df, column):
        return parse_datetime(_q(column))
    return _q(column)


def line_series(df: DataFrame, x: str, y: str, group_by: str | None = None) -> DataFrame:
    """Mean of ``y`` per ``x`` (and group): the points a line plot joins.
    ``x`` must be numeric or date/time-like (decided once); rows missing x or
    y are dropped."""
    if roles.is_numeric(df, x):
        xv = clean_numeric(df, x)
    elif is_datetime_like(df, x):
        xv = parse_datetime(_q(x)) if isinstance(df.schema[x].dataType, T.StringType) else _q(x)
    else:
        raise ValueError(f"{x!r} is neither numeric nor date/time")
    grouped = bool(group_by and group_by in df.columns)
    base = df.select(_group_label(df, group_by).alias("_g"), xv.alias("_x"),
                     clean_numeric(df, y).alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    out = base.groupBy("_g", "_x").agg(F.avg("_y").alias("y_mean"), F.count(F.lit(1)).alias("n"))
    name = x if x not in ("y_mean", "n") else f"{x}_x"
    out = out.withColumnRenamed("_x", name)
    if not grouped:
        return out.drop("_g").orderBy(_q(name))
    label = group_by if group_by not in out.columns else f"{group_by}_group"
    return out.withColumnRenamed("_g", label).orderBy(_q(label), _q(name))
