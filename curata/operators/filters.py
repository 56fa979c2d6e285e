"""Row filters: value ranges, chosen values, dropped values, complete rows.

All are single ``filter`` nodes over built-in predicates, so Catalyst pushes
them into the parquet scan whenever they sit on a source column.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import roles
from ..functions.exprs import text_not_in


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class RangeFilter:
    """Keep ``low <= column <= high``; missing never passes."""
    column: str
    low: float
    high: float

    def predicate(self, df: DataFrame) -> Column | None:
        c = _q(self.column)
        # plain comparisons on the raw column reach the parquet scan as
        # pushed filters; the NaN guard is a separate conjunct
        p = (c >= F.lit(self.low)) & (c <= F.lit(self.high))
        if isinstance(df.schema[self.column].dataType, (T.FloatType, T.DoubleType)):
            p = p & ~F.isnan(c)
        return p


@dataclass(frozen=True)
class ValueFilter:
    """Keep rows whose value is one of ``values`` (or missing, when
    ``include_missing``). An empty choice keeps nothing."""
    column: str
    values: tuple
    include_missing: bool = False

    def predicate(self, df: DataFrame) -> Column | None:
        c = _q(self.column)
        vals = list(self.values)
        hit = c.isin(vals) if vals else F.lit(False)
        if self.include_missing:
            hit = hit | c.isNull()
        return hit


def filter_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(RangeFilter(column, low, high).predicate(df))


def filter_in(df: DataFrame, column: str, values: Iterable, include_missing: bool = False) -> DataFrame:
    return df.where(ValueFilter(column, tuple(values), include_missing).predicate(df))


def combined_predicate(df: DataFrame, filters: Sequence) -> Column | None:
    """AND of the filters whose column exists; ``None`` when none applies.
    A range filter on a non-numeric column, or a value filter with ``values``
    ``None``, is skipped (no control)."""
    cond = None
    for f in filters:
        if f is None or f.column not in df.columns:
            continue
        if isinstance(f, RangeFilter) and not roles.is_numeric(df, f.column):
            continue
        if isinstance(f, ValueFilter) and f.values is None:
            continue
        p = f.predicate(df)
        cond = p if cond is None else cond & p
    return cond


def filter_all(df: DataFrame, filters: Sequence) -> DataFrame:
    """All filters in one ``filter`` node."""
    cond = combined_predicate(df, filters)
    return df if cond is None else df.where(cond)  # a NULL condition keeps no row


def filter_status(df: DataFrame, filters: Sequence) -> DataFrame:
    """Rows before and after the filters, in one aggregate."""
    cond = combined_predicate(df, filters)
    after = F.count(F.lit(1)) if cond is None else F.count_if(cond)
    return df.agg(F.count(F.lit(1)).alias("rows_before"), after.alias("rows_after"))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows missing (NULL or NaN) in any of ``columns``."""
    cond = None
    for name in columns:
        c = _q(name)
        ok = c.isNotNull()
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            ok = ok & ~F.isnan(c)
        cond = ok if cond is None else cond & ok
    return df if cond is None else df.where(cond)


@dataclass(frozen=True)
class DropRule:
    """Drop rows whose text form is one of ``values``; ``enabled`` toggles it."""
    column: str
    values: tuple
    enabled: bool = True


def parse_drop_rule(column: str, text: str) -> DropRule | None:
    """Comma list, trimmed, de-duplicated, sorted; empty input gives ``None``."""
    if not column or not text or not text.strip():
        return None
    vals = sorted({v.strip() for v in text.split(",") if v.strip()})
    return DropRule(column, tuple(vals)) if vals else None


def drop_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Drop rows whose value, as text, is in ``values``; missing cells match
    ``nan`` / ``<NA>`` / ``None``."""
    return df.where(text_not_in(_q(column), df.schema[column].dataType, values))
