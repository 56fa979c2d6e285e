from conftest import formatted_plan
from pyspark.sql import functions as F

from curata.operators import clean
from curata.operators.filters import (DropRule, RangeFilter, ValueFilter, complete_rows,
                                      drop_values, filter_all, filter_in, filter_range,
                                      filter_status, parse_drop_rule)


def test_trim_unicode_space(spark):
    df = spark.createDataFrame([("\t a b \n",), (" x　",), ("",), (None,)], "s string")
    assert [r["s"] for r in clean.trim_strings(df).collect()] == ["a b", "x", "", None]


def test_names_and_dedup(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, None)], "`Order Key` int, `A-b` string")
    out, m = clean.clean_names(df)
    assert out.columns == ["order_key", "a_b"] and m["Order Key"] == "order_key"
    assert clean.drop_duplicates(out).count() == 2            # missing equals missing


def test_missing_thresholds(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3, None), (3, 4, 5)], "a int, b int, c int")
    assert clean.drop_rows_missing(df, 34).count() == 2
    assert clean.drop_rows_missing(df, 0).count() == 1
    kept, dropped = clean.drop_cols_missing(df, 50)
    assert kept.columns == ["a", "b"] and dropped == ["c"]


def test_casts_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1.0", "x", "2.5"), ("20", "3", "4", None)],
                               "a string, b string, c string, d string")
    out, done, skipped = clean.cast_columns(df, ["a", "b", "c", "d"], "integer")
    assert done == ["a", "b"] and skipped == ["c", "d"]
    assert [(r["a"], r["b"]) for r in out.collect()] == [(1, 1), (20, 3)]
    assert dict(out.dtypes)["c"] == "string"
    out, done, _ = clean.cast_columns(df, ["d", "c"], "float")
    assert done == ["d"] and dict(out.dtypes)["d"] == "double"
    out, _, _ = clean.cast_columns(df, ["a"], "category")
    assert out.schema["a"].metadata["curata_role"] == "categorical"


def test_filters(spark, numbers):
    assert filter_range(numbers, "x", 0, 10).count() == 4           # NULL and NaN never pass
    assert filter_in(numbers, "g", ["a"]).count() == 4
    assert filter_in(numbers, "g", ["a"], include_missing=True).count() == 5
    assert filter_in(numbers, "g", []).count() == 0
    fs = [RangeFilter("i", 0, 5), ValueFilter("g", ("a", "b")), RangeFilter("nope", 0, 1)]
    assert filter_all(numbers, fs).count() == 4
    st = filter_status(numbers, fs).first()
    assert (st["rows_before"], st["rows_after"]) == (9, 4)
    assert complete_rows(numbers, ["i", "x"]).count() == 7


def test_drop_values_text_forms(spark, numbers):
    assert parse_drop_rule("g", " b, a ,, a") == DropRule("g", ("a", "b"))
    assert parse_drop_rule("g", "  ") is None
    assert drop_values(numbers, "x", ["1.0"]).count() == 8            # 1.0 prints as "1.0"
    assert drop_values(numbers, "x", ["1"]).count() == 9              # ... not "1"
    assert drop_values(numbers, "x", ["1000000000.0"]).count() == 8
    assert drop_values(numbers, "x", ["nan"]).count() == 7            # NULL and NaN
    assert drop_values(numbers, "g", ["<NA>", "a"]).count() == 4
    assert drop_values(numbers, "i", ["-3", "0"]).count() == 7
    b = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert drop_values(b, "b", ["True"]).count() == 2


def test_casts_take_nan_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, "1.5"), (nan, "nan"), (None, None)], "x double, t string")
    out, done, skipped = clean.cast_columns(df, ["x"], "integer")
    assert done == ["x"] and [r["x"] for r in out.collect()] == [1, None, None]
    out, done, _ = clean.cast_columns(df, ["t"], "float")
    assert done == ["t"] and [r["t"] for r in out.collect()] == [1.5, None, None]
    from curata.plans.recipe import CleaningRecipe
    frozen = CleaningRecipe(convert_dtype=True, dtype_cols=("x",), dtype_target="integer").fit(df).transform(df)
    assert [r["x"] for r in frozen.collect()] == [1, None, None]


def test_drop_values_compares_text(spark):
    from curata.operators.filters import drop_values
    df = spark.createDataFrame([(5,), (-3,), (None,)], "k int")
    assert [r["k"] for r in drop_values(df, "k", ["05", "--5", "5.0", "99999999999999999999"]).collect()] == [5, -3, None]
    assert [r["k"] for r in drop_values(df, "k", ["5", "-3"]).collect()] == [None]
    assert [r["k"] for r in drop_values(df, "k", ["nan"]).collect()] == [5, -3]
    x = spark.createDataFrame([(5.0,), (float("nan"),), (None,)], "x double")
    assert x.count() - drop_values(x, "x", ["nan"]).count() == 2 and drop_values(x, "x", ["5.0"]).count() == 2


def test_filters_reach_the_scan(spark):
    from curata.operators.filters import RangeFilter, ValueFilter, drop_values, filter_all
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = formatted_plan(filter_all(df, [RangeFilter("o_totalprice", 1.0, 2.0), ValueFilter("o_orderstatus", ("F",), True)]))
    assert "GreaterThanOrEqual(o_totalprice,1.0)" in plan and "IsNull(o_orderstatus)" in plan
    plan = formatted_plan(drop_values(df, "o_orderstatus", ["F", "O"]))
    assert "PushedFilters: [Or(IsNull(o_orderstatus),Not(In(o_orderstatus, [" in plan
