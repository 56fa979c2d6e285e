"""Steps with fitted statistics: imputation, scaling, IQR fences (cap or
remove), the ln gate and one-hot encoding.

Each step is ``fit`` (one aggregate job, a few numbers back to the driver) and
``transform`` (column expressions with those numbers as literals), so a rule
fitted on one table can be applied to another, or to a stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import roles
from ..functions.exprs import clean_numeric
from ..functions.names import make_unique, spell
from .heavy import top_values
from .quantiles import exact_quantiles
from .summary import unpivot_numeric


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _project(df: DataFrame, replace: dict[str, Column], append: Sequence[Column] = (),
             drop: Sequence[str] = ()) -> DataFrame:
    """One ``select`` that replaces, drops and appends columns (never a
    ``withColumn`` loop)."""
    cols = [replace.get(c, _q(c)) for c in df.columns if c not in set(drop)]
    return df.select(*cols, *append)


def _quantiles_by_column(df: DataFrame, cols: Sequence[str], probs, names) -> dict[str, dict]:
    """Exact quantiles of several columns with one distributed job chain;
    the result has one row per column (bounded) and is collected."""
    if not cols:
        return {}
    long = unpivot_numeric(df, [], cols)
    qs = exact_quantiles(long, ["variable"], "value", probs, names)
    return {r["variable"]: r.asDict() for r in qs.collect()}


# ---------------------------------------------------------------- imputation

@dataclass(frozen=True)
class ImputeModel:
    numeric_fill: dict          # column -> fill value (None: all missing)
    categorical_fill: dict      # column -> mode
    method: str

    def transform(self, df: DataFrame) -> DataFrame:
        rep = {}
        for c, v in self.numeric_fill.items():
            if c in df.columns:
                x = clean_numeric(df, c)
                rep[c] = (F.coalesce(x, F.lit(v)) if v is not None else x).alias(c)
        for c, v in self.categorical_fill.items():
            if c in df.columns:
                f = df.schema[c]
                fill = F.lit(v).cast(f.dataType)
                rep[c] = F.coalesce(_q(c), fill).alias(c, metadata=f.metadata)
        return _project(df, rep)

    @property
    def n_numeric(self) -> int:
        return len(self.numeric_fill)

    @property
    def n_categorical(self) -> int:
        return len(self.categorical_fill)


def fit_impute(df: DataFrame, method: str = "mean") -> ImputeModel:
    """Numeric columns with a missing cell get the mean or exact median;
    text/category columns get the mode (the smallest value on ties).
    Booleans are never imputed. An all-missing numeric column counts as
    imputed and stays missing; an all-missing text column is left alone."""
    if method not in ("mean", "median"):
        raise ValueError(f"unknown imputation {method!r}")
    num = roles.numeric_columns(df)
    cat = roles.categorical_columns(df, include_bool=False)
    if not num and not cat:
        return ImputeModel({}, {}, method)
    aggs = []
    for i, c in enumerate(num):
        x = clean_numeric(df, c)
        aggs.append(F.count_if(x.isNull()).alias(f"n{i}"))
        if method == "mean":
            aggs.append(F.avg(x).alias(f"v{i}"))
    for i, c in enumerate(cat):
        aggs += [F.count_if(_q(c).isNull()).alias(f"c{i}"), F.approx_count_distinct(_q(c)).alias(f"d{i}")]
    r = df.agg(*aggs).first()
    num_missing = [c for i, c in enumerate(num) if r[f"n{i}"]]
    cat_missing = [c for i, c in enumerate(cat) if r[f"c{i}"]]
    numeric_fill = {}
    if method == "mean":
        for i, c in enumerate(num):
            if r[f"n{i}"]:
                numeric_fill[c] = r[f"v{i}"]
    else:
        med = _quantiles_by_column(df, num_missing, [0.5], ["median"])
        for c in num_missing:
            numeric_fill[c] = med.get(c, {}).get("median")
    categorical_fill = {}
    if cat_missing:
        modes = column_modes(df, cat_missing, {c: r[f"d{i}"] for i, c in enumerate(cat)})
        for c in cat_missing:
            if modes.get(c) is not None:
                categorical_fill[c] = modes[c]
    return ImputeModel(numeric_fill, categorical_fill, method)


#: Columns with more distinct values than this (by HyperLogLog) are not counted
#: value by value; the modes are the same either way.
SKETCH_VALUES = 200_000


def column_modes(df: DataFrame, columns: Sequence[str], distinct: dict[str, int] | None = None) -> dict[str, object]:
    """Most frequent non-missing value of each column, the smallest on ties.

    Columns of one type share a job: unpivot to (column, value), count per
    pair with a partial aggregate, then keep the min of (-count, value) per
    column, so no column's distinct values are ever held by one task, and ties
    are ordered as their own type orders them. Columns of very many distinct
    values go through :func:`heavy.top_values` instead of shuffling them all;
    ``distinct`` gives estimates of their numbers if they are known."""
    if not columns:
        return {}
    if distinct is None:
        r = df.agg(*[F.approx_count_distinct(_q(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
        distinct = {c: r[f"d{i}"] for i, c in enumerate(columns)}
    many = [c for c in columns if distinct[c] > SKETCH_VALUES]
    modes: dict[str, object] = {c: top[0][0] for c, top in top_values(df, {c: _q(c) for c in many}).items() if top}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        if c not in many:
            by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for same in by_type.values():
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), _q(c).alias("value"))
            for c in same])).alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column").agg(
            F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("b"))
        modes.update((r["column"], r["b"]["value"]) for r in best.collect())
    return modes


# ------------------------------------------------------------------- scaling

@dataclass(frozen=True)
class ScaleModel:
    method: str
    params: dict                # column -> (center, scale)

    def transform(self, df: DataFrame) -> DataFrame:
        rep = {}
        for c, (center, scale) in self.params.items():
            if c in df.columns:
                rep[c] = ((clean_numeric(df, c) - F.lit(center)) / F.lit(scale)).alias(c)
        return _project(df, rep)


def fit_scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> ScaleModel:
    """z-score with the population sd, or min-max to [0, 1]; a zero spread is
    taken as 1 (constant columns become 0). Missing values are ignored in the
    fit and stay missing. An empty table gets no parameters."""
    if method not in ("standard", "minmax"):
        raise ValueError(f"unknown scaling {method!r}")
    cols = [c for c in columns if c in df.columns and roles.is_numeric_field(df.schema[c], True)]
    if not cols:
        return ScaleModel(method, {})
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = clean_numeric(df, c)
        if method == "standard":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        else:
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    if not r["rows"]:
        return ScaleModel(method, {})
    params = {}
    for i, c in enumerate(cols):
        a, b = r[f"a{i}"], r[f"b{i}"]
        if a is None:
            continue
        if method == "standard":
            params[c] = (a, b if b else 1.0)
        else:
            spread = b - a
            params[c] = (a, spread if spread else 1.0)
    return ScaleModel(method, params)


# ------------------------------------------------------------ IQR / outliers

@dataclass(frozen=True)
class Fences:
    bounds: dict                # column -> (low, high); columns with IQR 0 or none left out

    def cap(self, df: DataFrame) -> DataFrame:
        rep = {}
        for c, (lo, hi) in self.bounds.items():
            x = clean_numeric(df, c) if not roles.is_integral(df, c) else _q(c)
            capped = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
            rep[c] = F.when(x.isNotNull(), capped).alias(c)
        return _project(df, rep)

    def keep_predicate(self, df: DataFrame) -> Column | None:
        """Plain comparisons on the raw columns, which the scan can evaluate."""
        cond = None
        for c, (lo, hi) in self.bounds.items():
            p = (_q(c) >= F.lit(lo)) & (_q(c) <= F.lit(hi))
            if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
                p = p & ~F.isnan(_q(c))
            cond = p if cond is None else cond & p
        return cond

    def remove(self, df: DataFrame) -> DataFrame:
        cond = self.keep_predicate(df)
        return df if cond is None else df.where(cond)


def fit_fences(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> Fences:
    """``Q1 - m*IQR`` and ``Q3 + m*IQR`` per column from exact quantiles of
    the table before any row is removed; IQR 0 or undefined gives no fence."""
    cols = [c for c in columns if c in df.columns and roles.is_numeric(df, c)]
    qs = _quantiles_by_column(df, cols, [0.25, 0.75], ["q1", "q3"])
    bounds = {}
    for c in cols:
        r = qs.get(c)
        if not r or r["q1"] is None or r["q3"] is None:
            continue
        iqr = r["q3"] - r["q1"]
        if iqr == 0:
            continue
        bounds[c] = (r["q1"] - multiplier * iqr, r["q3"] + multiplier * iqr)
    return Fences(bounds)


# ------------------------------------------------------------------ ln gate

def ln_ready(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Number columns (booleans too) without a missing cell and with all
    values > 0; one aggregate for all."""
    cols = [c for c in columns if c in df.columns and roles.is_numeric_field(df.schema[c], True)]
    if not cols:
        return []
    r = df.agg(*[F.count_if(clean_numeric(df, c).isNull() | (clean_numeric(df, c) <= 0)).alias(f"b{i}")
                 for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if r[f"b{i}"] == 0]


def apply_ln(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _project(df, {c: F.ln(clean_numeric(df, c)).alias(c) for c in columns})


def ln_transform(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Natural log in place of the columns that :func:`ln_ready` lets pass;
    the other number columns are skipped."""
    cols = [c for c in columns if c in df.columns and roles.is_numeric_field(df.schema[c], True)]
    done = ln_ready(df, cols)
    return (apply_ln(df, done) if done else df), done, [c for c in cols if c not in done]


# ------------------------------------------------------------------ one-hot

def distinct_values(df: DataFrame, columns: Sequence[str], max_levels: int | None = None,
                    order_by: str | None = None) -> dict[str, list]:
    """Distinct non-missing values of each column, sorted in their own type or,
    with ``order_by`` (a position from a reader), by where each is met first,
    by one distributed distinct over (column, value). Every value becomes a column of the result,
    so they fit a plan by nature; ``max_levels`` makes more of them an error."""
    if not columns:
        return {}
    kinds = list(dict.fromkeys(df.schema[c].dataType.simpleString() for c in columns))
    cells = []
    for i, c in enumerate(columns):
        dt = df.schema[c].dataType
        v = _q(c)
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            v = F.when(~F.isnan(v), v + F.lit(0.0).cast(dt))
        # one value field for each type: only that of the column's own is filled
        own = [(v if k == dt.simpleString() else F.lit(None).cast(k)).alias(f"v{j}") for j, k in enumerate(kinds)]
        cells.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("column"), *own)))
    at = [_q(order_by).alias("at")] if order_by else []
    rows = df.select(F.explode(F.array(*cells)).alias("r"), *at).where("r is not null").select("r.*", *("at" for _ in at))
    rows = rows.groupBy("column", *(f"v{j}" for j in range(len(kinds)))).agg(F.min("at").alias("at")) if at else rows.distinct()
    if max_levels is not None:  # so many rows hold a column with too many
        rows = rows.limit(len(columns) * max_levels + 1)
    found: dict[str, list] = {c: [] for c in columns}
    for r in rows.collect():
        c = columns[r["column"]]
        v = r[f"v{kinds.index(df.schema[c].dataType.simpleString())}"]
        found[c].append((r["at"], v) if at else v)
    for c, values in found.items():
        if max_levels is not None and len(values) > max_levels:
            raise ValueError(f"column {c!r} has more than {max_levels} distinct values")
        values.sort()
    return {c: [v for _, v in values] for c, values in found.items()} if at else found


def _value_text(v) -> str:
    if isinstance(v, bool):
        return "True" if v else "False"
    return str(v)


@dataclass(frozen=True)
class OneHotModel:
    levels: dict                # column -> list of values (sorted, or as first met)
    keep_source: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        """Cells are compared as values of the column's type; their text only
        names the new columns."""
        existing = [c for c in df.columns if not (not self.keep_source and c in self.levels)]
        new_names, new_exprs = [], []
        for c, vals in self.levels.items():
            if c not in df.columns:
                continue
            for v in vals:
                same = _q(c) == F.lit(v).cast(df.schema[c].dataType)
                if self.keep_source:
                    name = f"{c}_is_{spell(_value_text(v), symbols_part=True)}"
                    e = F.coalesce(same, F.lit(False))
                else:
                    name = f"{c}_{_value_text(v)}"
                    e = F.when(same, 1).otherwise(0)
                new_names.append(name)
                new_exprs.append(e)
        unique = make_unique(existing + new_names)[len(existing):]
        drop = [] if self.keep_source else list(self.levels)
        return _project(df, {}, [e.alias(n) for e, n in zip(new_exprs, unique)], drop=drop)


def fit_one_hot(df: DataFrame, columns: Sequence[str] | None = None, keep_source: bool = False,
                max_levels: int | None = None, order_by: str | None = None) -> OneHotModel:
    """Levels of each column. Replacing encoding (``keep_source=False``)
    without a list encodes every text/category column and ignores non-text
    columns in a list; the keeping form takes any column. ``order_by`` (a
    position from a reader) puts the new columns in order of first appearance."""
    if keep_source:
        cols = [c for c in (columns or []) if c in df.columns]
    else:
        cat = roles.categorical_columns(df, include_bool=False)
        cols = [c for c in columns if c in cat] if columns else cat
    return OneHotModel(distinct_values(df, cols, max_levels, order_by), keep_source)
