"""Cleaning steps without fitted statistics: names, white space, duplicates,
missing-value thresholds and type casts. Casts are all-or-nothing per column,
decided for all chosen columns in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import roles
from ..functions.exprs import bool_text, nan_to_null, strip_ws, text_to_double, text_to_long
from ..functions.names import standardize_names


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def clean_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Standardised, unique names; returns the table and old -> new map.
    A rename is metadata only (no job)."""
    old = df.columns
    new = standardize_names(old)
    return df.toDF(*new), dict(zip(old, new))


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip leading/trailing white space (Unicode included) in text columns."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(strip_ws(_q(f.name)).alias(f.name, metadata=f.metadata))
        else:
            cols.append(_q(f.name))
    return df.select(*cols)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row distinct, missing equal to missing. Spark plans it as an
    aggregate with a map-side partial step, so repeated rows collapse before
    the shuffle even when one row is repeated billions of times."""
    return df.dropDuplicates()


def missing_flags(df: DataFrame) -> list[Column]:
    out = []
    for f in df.schema.fields:
        m = _q(f.name).isNull()
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            m = m | F.isnan(_q(f.name))
        out.append(m)
    return out


def drop_rows_missing(df: DataFrame, threshold_pct: float) -> DataFrame:
    """Keep rows whose share of missing cells is at most ``threshold_pct`` %."""
    n = len(df.columns)
    if n == 0:
        return df
    total = None
    for m in missing_flags(df):
        t = m.cast("int")
        total = t if total is None else total + t
    return df.where(total / F.lit(float(n)) <= F.lit(float(threshold_pct) / 100.0))


def drop_cols_missing(df: DataFrame, threshold_pct: float) -> tuple[DataFrame, list[str]]:
    """Keep columns whose missing share is at most ``threshold_pct`` %: one
    aggregate row, then a projection. Returns the table and dropped names."""
    if not df.columns:
        return df, []
    flags = missing_flags(df)
    r = df.agg(*[F.avg(m.cast("double")).alias(f"m{i}") for i, m in enumerate(flags)]).first()
    t = float(threshold_pct) / 100.0
    keep, dropped = [], []
    for i, name in enumerate(df.columns):
        share = r[f"m{i}"]
        if share is None or share <= t:
            keep.append(name)
        else:
            dropped.append(name)
    return df.select(*[_q(c) for c in keep]), dropped


CAST_TARGETS = ("category", "string", "integer", "float")


def _number(field: T.StructField) -> Column:
    """The cell as double; NaN, and the text of it, is missing."""
    c = _q(field.name)
    if isinstance(field.dataType, T.StringType):
        return nan_to_null(text_to_double(c))
    return nan_to_null(c.cast("double"))


def _is_missing(field: T.StructField) -> Column:
    c = _q(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if isinstance(field.dataType, T.StringType):
        return c.isNull() | F.lower(F.trim(c)).isin("nan", "+nan", "-nan")
    return c.isNull()


def castable(df: DataFrame, columns: Sequence[str], target: str) -> list[str]:
    """Columns whose every non-missing cell is a number (for ``integer`` a whole
    one in range); any column for the text targets. One aggregate for all."""
    if target not in CAST_TARGETS:
        raise ValueError(f"unknown cast target {target!r}")
    columns = [c for c in columns if c in df.columns]
    if target in ("category", "string") or not columns:
        return columns
    checks = []
    for i, c in enumerate(columns):
        f = df.schema[c]
        x = _number(f)
        bad = x.isNull()
        if target == "integer":
            bad = bad | (x != F.floor(x)) | (F.abs(x) > F.lit(9.2e18))
        checks.append(F.count_if(~_is_missing(f) & bad).alias(f"b{i}"))
    r = df.agg(*checks).first()
    return [c for i, c in enumerate(columns) if not r[f"b{i}"]]


def apply_casts(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """The casts that :func:`castable` allowed, as expressions without a check."""
    out = []
    for f in df.schema.fields:
        c = _q(f.name)
        if f.name not in columns:
            out.append(c)
        elif target == "category":
            out.append(roles.categorical(c, f.name))
        elif target == "string":
            out.append((bool_text(c) if isinstance(f.dataType, T.BooleanType) else c.cast("string")).alias(f.name))
        elif target == "float":
            out.append(_number(f).alias(f.name))
        elif isinstance(f.dataType, roles.INTEGRAL_TYPES):
            out.append(c.cast("long").alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.coalesce(text_to_long(c), _number(f).cast("long")).alias(f.name))
        else:
            out.append(_number(f).cast("long").alias(f.name))
    return df.select(*out)


def cast_columns(df: DataFrame, columns: Sequence[str], target: str
                 ) -> tuple[DataFrame, list[str], list[str]]:
    """Cast ``columns`` to ``category`` / ``string`` / ``integer`` / ``float``.

    A column with a cell that does not parse (or, for integer, is not whole)
    stays as it is. Returns the table, converted and skipped names.
    """
    columns = [c for c in columns if c in df.columns]
    done = castable(df, columns, target)
    return (apply_casts(df, done, target) if done else df), done, [c for c in columns if c not in done]
