"""Property tests (hypothesis) from the test strategy: idempotent cleaning,
capped values inside the fences, one-hot rows summing to 0 or 1, histogram
counts summing to the non-missing rows, percentages summing to ~100."""

import math

from hypothesis import given, settings, strategies as st

from curata.operators import clean, fit, plotdata, summary
from curata.plans.recipe import CleaningRecipe

SETTINGS = settings(max_examples=8, deadline=None)
texts = st.one_of(st.none(), st.sampled_from(["a", " a", "b ", "\tb", "c", "  "]))
nums = st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False))


@SETTINGS
@given(st.lists(st.tuples(texts, nums), min_size=1, max_size=25))
def test_clean_is_idempotent(spark, rows):
    df = spark.createDataFrame(rows, "`Some Text` string, `A-Number` double")
    recipe = CleaningRecipe(remove_duplicates=True)
    once, _ = recipe.apply(df)
    twice, _ = recipe.apply(once)
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)
    assert once.columns == twice.columns


@SETTINGS
@given(st.lists(nums, min_size=1, max_size=40))
def test_capped_within_fences(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    f = fit.fit_fences(df, ["x"], 1.5)
    out = [r["x"] for r in f.cap(df).collect()]
    assert [v is None for v in out] == [v is None for v in xs]
    if "x" in f.bounds:
        lo, hi = f.bounds["x"]
        assert all(lo <= v <= hi for v in out if v is not None)


@SETTINGS
@given(st.lists(texts, min_size=1, max_size=30))
def test_one_hot_rows_sum_to_zero_or_one(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "s string")
    out = fit.fit_one_hot(df).transform(df)
    for r in out.collect():
        assert sum(r) in (0, 1)


@SETTINGS
@given(st.lists(nums, min_size=1, max_size=40), st.integers(1, 12))
def test_histogram_counts_sum(spark, xs, bins):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    h = plotdata.histogram(df, "x", bins).collect()
    assert len(h) == bins
    assert sum(r["count"] for r in h) == sum(x is not None for x in xs)


@SETTINGS
@given(st.lists(texts, min_size=1, max_size=40))
def test_percentages_sum_to_100(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "s string")
    rows = summary.categorical_summary(df, "s").collect()
    assert sum(r["count"] for r in rows) == len(xs)
    assert math.isclose(sum(r["percentage"] for r in rows), 100.0, abs_tol=0.01 * len(rows))
