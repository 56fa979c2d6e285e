"""The cleaning recipe: ten steps in a fixed order, fitted once, replayed as
expressions.

``CleaningRecipe.fit(df)`` walks the steps on ``df``; each step that needs
statistics (missing-column shares, cast checks, imputation, scaling, one-hot
levels, ln gate, IQR fences) runs one aggregate on the output of the previous
step and freezes the numbers. The result, ``FittedCleaning``, is a list of
pure DataFrame -> DataFrame stages: applying it to ``df`` gives the cleaned
table, and applying it to another table, or to a streaming DataFrame, cleans
that the same way without refitting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import roles
from ..functions.names import ColumnTrail
from ..operators import clean, fit
from ..operators.filters import DropRule, drop_values
from ..session import materialize

MISSING_STRATEGIES = ("none", "drop_rows", "drop_cols", "mean_mode", "median_mode")
SCALING_METHODS = ("none", "standard", "minmax")
OUTLIER_ACTIONS = ("cap", "remove")
KEEP_MODES = ("none", "persist", "write")


@dataclass
class StepRecord:
    """What one step did. ``action`` says what became of the table: ``changed``,
    ``kept`` (nothing to do, or switched off) or ``refused`` (columns that the
    step could not take). ``rows_before`` / ``rows_after`` are observations of
    a step that may remove rows."""
    step: str
    action: str
    columns: tuple = ()
    setting: str = ""
    rows_before: Observation | None = None
    rows_after: Observation | None = None

    @property
    def applied(self) -> bool:
        return self.action == "changed"

    def text(self, removed: int | None) -> str:
        parts = [f"{self.step}: {self.action}"]
        if self.setting:
            parts.append(f"({self.setting})")
        if self.columns:
            parts.append("- " + ", ".join(self.columns))
        if removed is not None:
            parts.append(f"- {removed} row(s) fewer")
        return " ".join(parts)


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@dataclass
class StepLog:
    """One record per step. Rows are counted by observations inside the plan,
    in the first full action that runs it (a fit, a write, a count). Only when
    none has run does :meth:`lines` run one action itself."""
    records: list[StepRecord] = field(default_factory=list)
    result: DataFrame | None = None
    rows: Observation | None = None

    def add(self, step: str, action: str, columns=(), setting: str = "", before=None, after=None) -> None:
        self.records.append(StepRecord(step, action, tuple(columns), setting, before, after))

    def _count(self, seen: Observation) -> int:
        if not seen._jo.future().isCompleted():
            # an action's observations arrive on the listener bus, behind its end
            self.result.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        if not seen._jo.future().isCompleted():
            self.result.write.format("noop").mode("overwrite").save()
        return int(seen.get["rows"])

    def removed(self, r: StepRecord) -> int | None:
        if r.rows_before is None or r.rows_after is None:
            return None
        return self._count(r.rows_before) - self._count(r.rows_after)

    def lines(self) -> list[str]:
        out = [r.text(self.removed(r)) for r in self.records]
        if self.rows is not None:
            out.append(f"result: {self._count(self.rows)} row(s), {len(self.result.columns)} column(s)")
        return out

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """step_no, step, action, columns, setting, rows_removed (NULL where a
        step removes none by nature)."""
        rows = [(i, r.step, r.action, ", ".join(r.columns), r.setting, self.removed(r)) for i, r in enumerate(self.records, 1)]
        return spark.createDataFrame(rows, "step_no int, step string, action string, columns string, setting string, rows_removed long")


Stage = Callable[[DataFrame], DataFrame]


@dataclass
class FittedCleaning:
    """Frozen cleaning: apply with ``transform`` to a batch or stream table."""
    stages: list[tuple[str, Stage]]
    rename_map: dict[str, str]

    def transform(self, df: DataFrame) -> DataFrame:
        for _, stage in self.stages:
            df = stage(df)
        return df


@dataclass(frozen=True)
class CleaningRecipe:
    """The reference's cleaning options with its defaults (names and trim on,
    everything else off). Column lists use the table's original names and
    follow the renames."""
    standardize_names: bool = True
    trim_strings: bool = True
    remove_duplicates: bool = False
    missing_strategy: str = "none"
    missing_threshold: float = 0.0          # percent
    convert_dtype: bool = False
    dtype_cols: tuple = ()
    dtype_target: str = "category"
    scaling_method: str = "none"
    scale_cols: tuple = ()
    encode_categorical: bool = False
    encode_cols: tuple = ()
    apply_log: bool = False
    log_cols: tuple = ()
    handle_outliers: bool = False
    outlier_cols: tuple = ()
    outlier_action: str = "cap"
    iqr_multiplier: float = 1.5
    drop_rules: tuple = ()
    keep_after_dedup: str = "none"          # "none" | "persist" | "write" (see below)

    def __post_init__(self):
        if self.missing_strategy not in MISSING_STRATEGIES:
            raise ValueError(f"missing_strategy must be one of {MISSING_STRATEGIES}")
        if self.scaling_method not in SCALING_METHODS:
            raise ValueError(f"scaling_method must be one of {SCALING_METHODS}")
        if self.outlier_action not in OUTLIER_ACTIONS:
            raise ValueError(f"outlier_action must be one of {OUTLIER_ACTIONS}")
        if self.dtype_target not in clean.CAST_TARGETS:
            raise ValueError(f"dtype_target must be one of {clean.CAST_TARGETS}")
        if self.keep_after_dedup not in KEEP_MODES:
            raise ValueError(f"keep_after_dedup must be one of {KEEP_MODES}")

    # rule list editing: add, delete, enable / disable
    def with_rule(self, rule: DropRule) -> CleaningRecipe:
        return replace(self, drop_rules=self.drop_rules + (rule,))

    def without_rule(self, index: int) -> CleaningRecipe:
        rules = list(self.drop_rules)
        del rules[index]
        return replace(self, drop_rules=tuple(rules))

    def toggled(self, index: int, enabled: bool) -> CleaningRecipe:
        rules = list(self.drop_rules)
        rules[index] = replace(rules[index], enabled=enabled)
        return replace(self, drop_rules=tuple(rules))

    def apply(self, df: DataFrame, count_steps: bool = True) -> tuple[DataFrame, StepLog]:
        """The cleaned table and its log. ``count_steps=False`` leaves the
        observations out, and with them the log's row counts."""
        _, out, log = self._fit(df, count_steps)
        return out, log

    def fit(self, df: DataFrame) -> FittedCleaning:
        return self._fit(df, False)[0]

    def _fit(self, df: DataFrame, count_steps: bool) -> tuple[FittedCleaning, DataFrame, StepLog]:
        return _Walk(self, df, count_steps).run()


class _Walk:
    """One walk over the steps: the table so far, the frozen stages, the log."""

    def __init__(self, recipe: CleaningRecipe, df: DataFrame, count_steps: bool):
        self.recipe, self.table, self.count_steps = recipe, df, count_steps
        self.trail = ColumnTrail(df.columns)
        self.stages: list[tuple[str, Stage]] = []
        self.log = StepLog()

    def run(self) -> tuple[FittedCleaning, DataFrame, StepLog]:
        for step in (self.names, self.trim, self.duplicates, self.missing, self.casts, self.scaling,
                     self.encoding, self.logarithm, self.outliers, self.value_filters):
            step()
        if self.count_steps:
            self.table, self.log.rows = _observed(self.table)
        self.log.result = self.table
        return FittedCleaning(self.stages, dict(self.trail.now)), self.table, self.log

    def _do(self, step: str, stage: Stage) -> None:
        self.stages.append((step, stage))
        self.table = stage(self.table)

    def _drop_rows(self, step: str, stage: Stage, columns=(), setting: str = "", then: Stage | None = None) -> None:
        """A step that may remove rows, counted on both sides."""
        before = after = None
        if self.count_steps:
            self.table, before = _observed(self.table)
        self._do(step, stage)
        if self.count_steps:
            self.table, after = _observed(self.table)
        if then:
            self.table = then(self.table)
        self.log.add(step, "changed", columns, setting, before, after)

    def _chosen(self, wanted) -> list[str]:
        return self.trail.find(wanted, self.table.columns)

    def names(self) -> None:
        if not self.recipe.standardize_names:
            return self.log.add("names", "kept", setting="off")
        old = self.table.columns
        new = list(clean.clean_names(self.table)[0].columns)
        self._do("names", lambda d, n=new: d.toDF(*n))
        self.trail.rename(new)
        moved = [n for o, n in zip(old, new) if o != n]
        self.log.add("names", "changed" if moved else "kept", moved)

    def trim(self) -> None:
        if not self.recipe.trim_strings:
            return self.log.add("trim", "kept", setting="off")
        self._do("trim", clean.trim_strings)
        self.log.add("trim", "changed")

    def duplicates(self) -> None:
        keep = self.recipe.keep_after_dedup
        if not self.recipe.remove_duplicates:
            return self.log.add("dedup", "kept", setting="off")
        # every later fit reads this table: it can be kept instead of running
        # the shuffle again per fit, cached ("persist": lost blocks are made
        # again from lineage) or as parquet in the shared folder ("write")
        then = (lambda d: materialize(d, cut_lineage=keep == "write")) if keep != "none" else None
        self._drop_rows("dedup", clean.drop_duplicates, then=then)

    def missing(self) -> None:
        how, share = self.recipe.missing_strategy, self.recipe.missing_threshold
        if how == "none":
            return self.log.add("missing", "kept", setting="off")
        if how == "drop_rows":
            return self._drop_rows("missing", lambda d, t=share: clean.drop_rows_missing(d, t), setting=f"rows over {share:g} % missing")
        if how == "drop_cols":
            _, dropped = clean.drop_cols_missing(self.table, share)
            left = [c for c in self.table.columns if c not in dropped]
            self._do("missing", lambda d, k=left: d.select(*[F.col(f"`{c}`") for c in k]))
            self.trail.keep(left)
            return self.log.add("missing", "changed" if dropped else "kept", dropped, f"columns over {share:g} % missing")
        model = fit.fit_impute(self.table, "mean" if how == "mean_mode" else "median")
        self._do("missing", model.transform)
        filled = [*model.numeric_fill, *model.categorical_fill]
        self.log.add("missing", "changed" if filled else "kept", filled, f"{model.method} or mode")

    def _on_columns(self, step: str, on: bool, wanted, ready, stage, setting: str = "") -> None:
        """A step on chosen columns: ``ready`` picks those it can take, ``stage``
        makes the stage for them."""
        if not on:
            return self.log.add(step, "kept", setting="off")
        chosen = self._chosen(wanted)
        done = ready(chosen) if chosen else []
        if done:
            self._do(step, stage(done))
            self.log.add(step, "changed", done, setting)
        left = [c for c in chosen if c not in done]
        if left:
            self.log.add(step, "refused", left, setting)
        elif not done:
            self.log.add(step, "kept", setting="no column given")

    def casts(self) -> None:
        target = self.recipe.dtype_target
        self._on_columns("cast", self.recipe.convert_dtype, self.recipe.dtype_cols,
                         lambda cols: clean.castable(self.table, cols, target),
                         lambda done: lambda d, c=tuple(done): clean.apply_casts(d, c, target), f"to {target}")

    def scaling(self) -> None:
        method = self.recipe.scaling_method
        models = []

        def ready(cols):
            models.append(fit.fit_scale(self.table, cols, method))
            return list(models[0].params)

        self._on_columns("scale", method != "none", self.recipe.scale_cols, ready, lambda done: models[0].transform, method)

    def encoding(self) -> None:
        if not self.recipe.encode_categorical:
            return self.log.add("one_hot", "kept", setting="off")
        model = fit.fit_one_hot(self.table, self._chosen(self.recipe.encode_cols) or None, keep_source=False)
        if model.levels:
            self._do("one_hot", model.transform)
        self.log.add("one_hot", "changed" if model.levels else "kept", model.levels)

    def logarithm(self) -> None:
        def number(cols):
            return [c for c in cols if roles.is_numeric_field(self.table.schema[c], True)]

        self._on_columns("ln", self.recipe.apply_log, self.recipe.log_cols,
                         lambda cols: fit.ln_ready(self.table, number(cols)),
                         lambda done: lambda d, c=tuple(done): fit.apply_ln(d, c))

    def outliers(self) -> None:
        if not self.recipe.handle_outliers:
            return self.log.add("outliers", "kept", setting="off")
        numeric = roles.numeric_columns(self.table)
        targets = [c for c in (self._chosen(self.recipe.outlier_cols) or numeric) if c in numeric]
        if not targets:
            return self.log.add("outliers", "kept", setting="no number column")
        fences = fit.fit_fences(self.table, targets, self.recipe.iqr_multiplier)
        setting = f"{self.recipe.outlier_action} beyond {self.recipe.iqr_multiplier:g} IQR"
        if self.recipe.outlier_action == "remove":
            return self._drop_rows("outliers", fences.remove, targets, setting)
        self._do("outliers", fences.cap)
        self.log.add("outliers", "changed" if fences.bounds else "kept", list(fences.bounds), setting)

    def value_filters(self) -> None:
        used = False
        for rule in self.recipe.drop_rules:
            column = self._chosen([rule.column]) if rule.enabled else []
            if column:
                used = True
                self._drop_rows("drop_values", lambda d, c=column[0], v=rule.values: drop_values(d, c, v),
                                column, "values " + ", ".join(sorted(rule.values)))
        if not used:
            self.log.add("drop_values", "kept", setting="no rule" if not self.recipe.drop_rules else "no rule in use")
