"""Correlation matrix, pair regressions and the scatter-matrix bundle.

All pairs come from one pass over the rows complete in every chosen column,
whatever the number of columns k. Up to ``PAIR_COLUMNS`` columns, the k variances
and k(k-1)/2 covariances are partial aggregates of one plan. A plan with tens of
thousands of aggregates would not compile, so more columns go through a blocked
Gram matrix: a task keeps one mean vector and one matrix of co-moments, updated
by whole batches, and gives k rows of it; these are merged row by row of the
matrix, first in groups of tasks and then over the groups, by the rule for means
and co-moments of two parts. A task shuffles k x 2k numbers however many rows it
read, and only the finished k x k matrix reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import roles
from ..functions.exprs import clean_numeric
from .filters import complete_rows
from .plotdata import histograms

MAX_SCATTER_COLUMNS = 6
#: Columns up to which each pair is an aggregate of its own.
PAIR_COLUMNS = 24
#: Groups of tasks whose matrices are merged first.
MERGE_GROUPS = 256


def _numeric(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in (cols or []) if c in df.columns and roles.is_numeric(df, c)]


def _pairs(cols: list[str]) -> list[tuple[str, str]]:
    """Lower triangle without the diagonal: (row variable, column variable)."""
    return [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i)]


def _stack(one: DataFrame, items: list[Column]) -> DataFrame:
    return one.select(F.inline(F.array(*items)))


_GRAM = "part int, i int, n long, mean array<double>, co array<double>"


def _gram_rows(part: int, rows: list[tuple]) -> pa.RecordBatch:
    """(i, n, mean, co) of rows of a co-moment matrix."""
    numbers = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], numbers), pa.array([r[3] for r in rows], numbers)], ["part", "i", "n", "mean", "co"])


def _gram(data: DataFrame, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and co-moments (sums of products of deviations) of the k
    columns of a table of doubles without missing cells."""

    def own(batches):
        n, mean, co = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            first = x[0].copy()
            x -= first  # a column of one value then deviates by 0 exactly
            centre = x.mean(axis=0)
            x -= centre
            step = centre + first - mean
            co += x.T @ x + np.outer(step, step) * (n * m / (n + m))
            mean += step * (m / (n + m))
            n += m
        if n:
            yield _gram_rows(TaskContext.get().partitionId() % MERGE_GROUPS, [(i, n, mean, co[i]) for i in range(k)])

    def merged(part: pa.Table) -> pa.Table:
        n, mean, co = 0, np.zeros(k), np.zeros(k)
        i = part.column("i")[0].as_py()
        for m, other, c in zip(part.column("n").to_pylist(), part.column("mean"), part.column("co"), strict=True):
            step = np.asarray(other.values) - mean
            co += np.asarray(c.values) + step[i] * step * (n * m / (n + m))
            mean += step * (m / (n + m))
            n += m
        return pa.Table.from_batches([_gram_rows(0, [(i, n, mean, co)])])

    rows = data.mapInArrow(own, _GRAM).groupBy("part", "i").applyInArrow(merged, _GRAM).groupBy("i").applyInArrow(merged, _GRAM)
    found = sorted(rows.collect(), key=lambda r: r["i"])
    if not found:
        return 0, np.zeros(k), np.zeros((k, k))
    return found[0]["n"], np.array(found[0]["mean"]), np.array([r["co"] for r in found])


def _doubles(data: DataFrame) -> DataFrame:
    return data.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(data.columns)])


def _ratio(a: float, b: float) -> float | None:
    return float(a / b) if b else None


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation over rows complete in all chosen columns, lower
    triangle in long form: ``var_y`` (row), ``var_x`` (column), ``corr``,
    ``n``. Undefined (constant column, < 2 rows) gives NULL, not an error."""
    cols = _numeric(df, columns)
    if len(cols) < 2:
        raise ValueError("at least two numeric columns are needed")
    data = complete_rows(df.select(*[clean_numeric(df, c).alias(c) for c in cols]), cols)
    if len(cols) > PAIR_COLUMNS:
        n, _, co = _gram(_doubles(data), len(cols))
        sd = np.sqrt(np.diag(co))
        rows = [(cols[i], cols[j], _ratio(co[i, j], sd[i] * sd[j]), n) for i in range(len(cols)) for j in range(i)]
        return df.sparkSession.createDataFrame(rows, "var_y string, var_x string, corr double, n long")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs.append(F.stddev_samp(F.col(f"`{c}`")).alias(f"s{i}"))
    pairs = _pairs(cols)
    for k, (a, b) in enumerate(pairs):
        aggs.append(F.covar_samp(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"c{k}"))
    one = data.agg(*aggs)
    idx = {c: i for i, c in enumerate(cols)}
    items = []
    for k, (a, b) in enumerate(pairs):
        r = F.try_divide(F.col(f"c{k}"), F.col(f"s{idx[a]}") * F.col(f"s{idx[b]}"))
        items.append(F.struct(F.lit(a).alias("var_y"), F.lit(b).alias("var_x"),
                              r.alias("corr"), F.col("n").alias("n")))
    return _stack(one, items)


def pair_regression(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least-squares line of each lower-triangle pair (y = row variable,
    x = column variable) over rows complete in all chosen columns."""
    cols = _numeric(df, columns)
    if len(cols) < 2:
        raise ValueError("at least two numeric columns are needed")
    data = complete_rows(df.select(*[clean_numeric(df, c).alias(c) for c in cols]), cols)
    if len(cols) > PAIR_COLUMNS:
        n, mean, co = _gram(_doubles(data), len(cols))
        rows = []
        for i in range(len(cols)):
            for j in range(i):
                slope = _ratio(co[i, j], co[j, j])
                rows.append((cols[i], cols[j], slope, None if slope is None else float(mean[i] - slope * mean[j]), n))
        return df.sparkSession.createDataFrame(rows, "var_y string, var_x string, slope double, intercept double, n long")
    pairs = _pairs(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, (a, b) in enumerate(pairs):
        ya, xb = F.col(f"`{a}`"), F.col(f"`{b}`")
        aggs += [F.regr_slope(ya, xb).alias(f"m{k}"), F.regr_intercept(ya, xb).alias(f"b{k}")]
    one = data.agg(*aggs)
    items = [F.struct(F.lit(a).alias("var_y"), F.lit(b).alias("var_x"),
                      F.col(f"m{k}").alias("slope"), F.col(f"b{k}").alias("intercept"),
                      F.col("n").alias("n")) for k, (a, b) in enumerate(pairs)]
    return _stack(one, items)


def scatter_matrix_data(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Everything a scatter-plot matrix shows, over complete rows: the
    diagonal histograms (18 bins; 20 for a single column), and for two or
    more columns the pair regressions and correlations. 1 to 6 columns."""
    cols = _numeric(df, columns)
    if not cols:
        raise ValueError("select at least one numeric column")
    if len(cols) > MAX_SCATTER_COLUMNS:
        raise ValueError(f"select at most {MAX_SCATTER_COLUMNS} numeric columns")
    data = complete_rows(df.select(*[clean_numeric(df, c).alias(c) for c in cols]), cols)
    bins = 20 if len(cols) == 1 else 18
    out = {"histograms": histograms(data, cols, bins)}
    if len(cols) >= 2:
        out["regressions"] = pair_regression(data, cols)
        out["correlations"] = correlation_matrix(data, cols)
    return out


def scatter_matrix_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The whole scatter matrix as one table: ``part`` (histogram, regression
    or correlation), the variables, the bin and its numbers, NULL where a part
    has none."""
    parts = scatter_matrix_data(df, columns)
    names = ["part", "var_y", "var_x", "bin", "bin_lo", "bin_hi", "count", "slope", "intercept", "corr", "n"]
    kinds = ["string", "string", "string", "int", "double", "double", "bigint", "double", "double", "double", "bigint"]
    out = None
    for part, table in parts.items():
        if "variable" in table.columns:
            table = table.withColumn("var_y", F.col("variable"))
        cells = [F.lit(part.removesuffix("s")) if n == "part" else F.col(n) if n in table.columns else F.lit(None)
                 for n in names]
        rows = table.select(*[c.cast(k).alias(n) for c, k, n in zip(cells, kinds, names, strict=True)])
        out = rows if out is None else out.unionByName(rows)
    return out
