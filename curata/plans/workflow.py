"""Load -> clean -> engineer -> explore as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.features import FeatureRules
from ..operators.filters import filter_all
from ..sources import load_table
from .recipe import CleaningRecipe, StepLog


@dataclass
class Prepared:
    raw: DataFrame
    cleaned: DataFrame
    features: DataFrame
    log: StepLog
    rule_errors: list = field(default_factory=list)

    def explore(self, filters=()) -> DataFrame:
        """The table the exploration tools read: the feature table, filtered."""
        return filter_all(self.features, list(filters))


def prepare(df: DataFrame, recipe: CleaningRecipe | None = None,
            rules: FeatureRules | None = None) -> Prepared:
    """Clean with ``recipe`` then apply the feature ``rules``. The cleaned
    table is built once and the rules extend that same plan (the reference
    cleans twice)."""
    recipe = recipe or CleaningRecipe()
    cleaned, log = recipe.apply(df)
    features, errors = (rules or FeatureRules()).apply(cleaned)
    return Prepared(df, cleaned, features, log, errors)


def prepare_file(spark: SparkSession, path: str, recipe: CleaningRecipe | None = None,
                 rules: FeatureRules | None = None) -> Prepared:
    return prepare(load_table(spark, path), recipe, rules)
