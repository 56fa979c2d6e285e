"""Feature rules: conditional mapping, binning, one-hot (source kept) and
log2. Building a rule may run one small fit (mean, median, min/max, levels)
and freezes the result; applying a rule is a column expression only."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import roles
from ..functions.exprs import bool_text, clean_numeric
from .fit import OneHotModel, distinct_values
from .summary import compare_stat, field_range

# Comparison operators a map rule may use.
MAP_OPERATORS = ("<", ">", "=", "<=", ">=")
NEW_COLUMN = re.compile(r"\w+", re.ASCII)
WHOLE = re.compile(r"[+-]?[0-9]+")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def new_column(name: str) -> str:
    """The name for a column that a rule makes: ASCII letters, digits, ``_``."""
    name = str(name or "").strip()
    if not NEW_COLUMN.fullmatch(name):
        raise ValueError(f"{name!r} cannot name a column: use letters, digits and _")
    return name


def parse_value(raw: str):
    """What a rule assigns: a truth value, a number (whole ones as int), else
    the text itself. Blank text and numbers that are not finite are refused."""
    text = raw.strip()
    truth = {"true": True, "false": False}.get(text.lower())
    if truth is not None:
        return truth
    if WHOLE.fullmatch(text):
        return int(text)
    try:
        number = float(text)
    except ValueError:
        if not text:
            raise ValueError("a rule needs a value to assign") from None
        return text
    if not math.isfinite(number):
        raise ValueError(f"{raw!r} is no finite number")
    return int(number) if number.is_integer() else number


# ---------------------------------------------------------------- map rules

@dataclass(frozen=True)
class MapRule:
    field: str
    operator: str
    threshold: float
    new_field: str
    true_value: object
    enabled: bool = True

    def condition(self, df: DataFrame) -> Column:
        x = clean_numeric(df, self.field) if roles.is_numeric_field(df.schema[self.field], True) \
            else _q(self.field)
        t = F.lit(self.threshold)
        return {"<": x < t, ">": x > t, "=": x == t, "<=": x <= t, ">=": x >= t}[self.operator]

    @property
    def label(self) -> str:
        return f"{self.new_field} := {self.true_value!r} where {self.field} {self.operator} {self.threshold:g}"


def make_map_rule(df: DataFrame, field: str, operator: str, method: str, new_field: str,
                  value: str, number: float | None = None) -> MapRule:
    """Freeze a rule: threshold is the column mean or median (unrounded) or
    ``number``; the new field name is checked; the value is parsed."""
    if operator not in MAP_OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    if method in ("mean", "median"):
        thr = compare_stat(df, field, method)
        if thr is None:
            raise ValueError(f"could not compute the {method} of {field!r}")
    else:
        thr = float(number)
    return MapRule(field, operator, thr, new_column(new_field), parse_value(str(value)))


def _lit_type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "bigint"
    if isinstance(v, float):
        return "double"
    return "string"


def apply_map_rules(df: DataFrame, rules: Sequence[MapRule]) -> DataFrame:
    """Map rules one after another: a rule sees what earlier rules wrote.

    Rules up to the next that reads an earlier target share one projection.
    Rules on one target form a CASE in which the later rule wins; rows no rule
    matches keep the target's earlier value (or missing). Mixed value types on
    one target become text. A new target is marked categorical; a column that
    was there keeps its role, if its type stays."""
    batch: list[MapRule] = []
    for rule in (r for r in rules if r.enabled):
        if rule.field in {r.new_field for r in batch}:
            df, batch = _map_batch(df, batch), []
        batch.append(rule)
    return _map_batch(df, batch) if batch else df


def _target_type(df: DataFrame, name: str, rules: Sequence[MapRule]) -> str:
    types = {_lit_type(r.true_value) for r in rules}
    if name in df.columns:
        types.add(df.schema[name].dataType.simpleString())
    if len(types) == 1:
        return types.pop()
    if types <= {"int", "bigint"}:
        return "bigint"
    return "double" if types <= {"int", "bigint", "float", "double"} else "string"


def _map_batch(df: DataFrame, rules: Sequence[MapRule]) -> DataFrame:
    """Rules that read only what the table holds now, in one projection."""
    targets: dict[str, list[MapRule]] = {}
    for r in rules:
        targets.setdefault(r.new_field, []).append(r)
    made = {}
    for name, own in targets.items():
        kind = _target_type(df, name, own)
        there = name in df.columns
        expr = F
        for r in reversed(own):
            v = r.true_value
            value = F.lit(str(v)) if isinstance(v, bool) and kind == "string" else F.lit(v).cast(kind)
            expr = expr.when(r.condition(df), value)
        if not there:
            made[name] = roles.categorical(expr.otherwise(F.lit(None).cast(kind)), name)
            continue
        before = df.schema[name]
        old = bool_text(_q(name)) if kind == "string" and before.dataType == T.BooleanType() else _q(name).cast(kind)
        made[name] = expr.otherwise(old).alias(name, metadata=before.metadata)
    return df.select(*[made.pop(c, _q(c)) for c in df.columns], *made.values())


# ------------------------------------------------------------------ binning

@dataclass(frozen=True)
class Bins:
    """Edges of right-closed bins and the label of each, fixed when made."""
    edges: tuple
    labels: tuple

    @classmethod
    def over(cls, low: float, cuts: Sequence[float], high: float, whole: bool) -> Bins:
        """Bins from ``low`` over ``cuts`` to ``high``. Labels read
        ``13-20``, ``21-30`` for whole numbers (a bin starts one above the
        edge, but for the first), else ``13.0-20.0``, ``20.0-30.0``."""
        edges = tuple(float(e) for e in (low, *cuts, high))
        spans = list(zip(edges, edges[1:]))
        if whole:
            labels = [f"{int(a) + (k > 0)}-{int(b)}" for k, (a, b) in enumerate(spans)]
        else:
            labels = [f"{a}-{b}" for a, b in spans]
        if len(set(labels)) < len(labels):
            raise ValueError(f"two bins would be called alike: {labels}")
        return cls(edges, tuple(labels))

    def label_of(self, x: Column) -> Column:
        """The label of each value; missing outside the edges."""
        first, *rest = zip(self.edges, self.edges[1:], self.labels)
        expr = F.when((x >= F.lit(first[0])) & (x <= F.lit(first[1])), F.lit(first[2]))
        for low, high, label in rest:
            expr = expr.when((x > F.lit(low)) & (x <= F.lit(high)), F.lit(label))
        return expr


def bin_labels(edges: Sequence[float], is_int: bool) -> list[str]:
    return list(Bins.over(edges[0], edges[1:-1], edges[-1], is_int).labels)


@dataclass(frozen=True)
class BinRule:
    field: str
    bins: Bins
    new_col: str
    enabled: bool = True

    @property
    def edges(self) -> tuple:
        return self.bins.edges

    @property
    def labels(self) -> tuple:
        return self.bins.labels

    def expression(self, df: DataFrame) -> Column:
        """Right-closed bins, lowest edge included, outside the edges missing."""
        return roles.categorical(self.bins.label_of(clean_numeric(df, self.field)), self.new_col, list(self.labels))


def make_bin_rule(df: DataFrame, field: str, cutoffs: Sequence[float] | str, new_col: str) -> BinRule:
    """Bins between the column's min and max (frozen), cut at ``cutoffs`` (each
    once, in order), which must all lie inside."""
    new_col = new_column(new_col)
    parts = cutoffs.split(",") if isinstance(cutoffs, str) else cutoffs
    cuts = sorted({float(c) for c in parts if str(c).strip()})
    if not cuts:
        raise ValueError("bins need a cutoff")
    ends = field_range(df, field)
    if ends is None:
        raise ValueError(f"{field!r} has no values")
    outside = [c for c in cuts if not ends[0] < c < ends[1]]
    if outside:
        raise ValueError(f"cutoffs {outside} are not inside the values of {field!r}, {ends[0]:g} to {ends[1]:g}")
    return BinRule(field, Bins.over(ends[0], cuts, ends[1], roles.is_integral(df, field)), new_col)


def apply_bin(df: DataFrame, rule: BinRule) -> DataFrame:
    expr = rule.expression(df)
    cols = [_q(c) for c in df.columns if c != rule.new_col]
    return df.select(*cols, expr)


# ------------------------------------------------------------ one-hot, log2

@dataclass(frozen=True)
class OneHotRule:
    field: str
    levels: tuple
    enabled: bool = True

    def apply(self, df: DataFrame) -> DataFrame:
        return OneHotModel({self.field: list(self.levels)}, keep_source=True).transform(df)


def make_one_hot_rule(df: DataFrame, field: str, existing: Sequence[OneHotRule] = (),
                      max_levels: int | None = None, order_by: str | None = None) -> OneHotRule:
    """Boolean ``field_is_value`` columns, source kept; a field once only. They
    are sorted by value, or by first appearance with ``order_by`` (a position
    from a reader)."""
    if field in [r.field for r in existing]:
        raise ValueError(f"there is a one-hot rule for {field!r}")
    return OneHotRule(field, tuple(distinct_values(df, [field], max_levels, order_by)[field]))


@dataclass(frozen=True)
class Log2Rule:
    field: str
    new_col: str
    enabled: bool = True

    def expression(self, df: DataFrame) -> Column:
        x = clean_numeric(df, self.field)
        return F.when(x > 0, F.log2(x)).alias(self.new_col)


def make_log2_rule(field: str, new_col: str, existing: Sequence[Log2Rule] = ()) -> Log2Rule:
    new_col = new_column(new_col)
    if any(r.new_col == new_col for r in existing):
        raise ValueError(f"a rule writing to {new_col!r} already exists")
    return Log2Rule(field, new_col)


def apply_log2(df: DataFrame, rule: Log2Rule) -> DataFrame:
    """New column: log2 where the value is > 0, else missing."""
    cols = [_q(c) for c in df.columns if c != rule.new_col]
    return df.select(*cols, rule.expression(df))


@dataclass
class FeatureRules:
    """Ordered rule lists with on/off flags, applied map -> bin -> one-hot ->
    log2 to the growing table; a failing rule is recorded and skipped."""
    maps: list = field(default_factory=list)
    bins: list = field(default_factory=list)
    one_hots: list = field(default_factory=list)
    logs: list = field(default_factory=list)

    def apply(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        steps = [("map", r.label, lambda d, r=r: apply_map_rules(d, [r])) for r in self.maps if r.enabled]
        steps += [("bin", r.field, lambda d, r=r: apply_bin(d, r)) for r in self.bins if r.enabled]
        steps += [("one-hot", r.field, lambda d, r=r: r.apply(d)) for r in self.one_hots if r.enabled]
        steps += [("log2", r.field, lambda d, r=r: apply_log2(d, r)) for r in self.logs if r.enabled]
        errors: list[str] = []
        try:  # the usual case: no map rule is bad, and they share projections
            df = apply_map_rules(df, self.maps)
            steps = [s for s in steps if s[0] != "map"]
        except Exception:  # then one by one, to tell which
            pass
        for kind, what, step in steps:
            try:
                df = step(df)
            except Exception as exc:  # one bad rule must not stop the rest
                errors.append(f"{kind} rule ({what}) not applied: {exc}")
        return df, errors
