from conftest import formatted_plan
import numpy as np
import pytest

from curata.operators import fit


def test_impute_mean_median_mode(spark):
    df = spark.createDataFrame(
        [(1.0, 10, "b", True), (None, None, "a", None), (3.0, 30, None, False), (8.0, 20, "a", True),
         (None, 40, "b", True)],
        "x double, n int, s string, flag boolean")
    m = fit.fit_impute(df, "mean")
    assert m.numeric_fill == {"x": 4.0, "n": 25.0}
    assert m.categorical_fill == {"s": "a"}                  # tie a/b: smallest
    out = m.transform(df).collect()
    assert out[1]["x"] == 4.0 and out[1]["n"] == 25.0 and out[2]["s"] == "a"
    assert out[1]["flag"] is None                            # booleans never imputed
    med = fit.fit_impute(df, "median")
    assert med.numeric_fill == {"x": 3.0, "n": 25.0}


def test_impute_all_missing(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    m = fit.fit_impute(df, "mean")
    assert m.n_numeric == 1 and m.numeric_fill["x"] is None and m.n_categorical == 0
    assert m.transform(df).where("x IS NULL").count() == 2


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    z = fit.fit_scale(df, ["x", "c"], "standard").transform(df).collect()
    sd = np.std([1, 2, 3])                                   # population sd
    assert [r["x"] for r in z] == pytest.approx([-1 / sd, 0, 1 / sd, None])
    assert {r["c"] for r in z} == {0.0}
    mm = fit.fit_scale(df, ["x", "c"], "minmax").transform(df).collect()
    assert [r["x"] for r in mm] == [0.0, 0.5, 1.0, None] and {r["c"] for r in mm} == {0.0}
    assert fit.fit_scale(df.limit(0), ["x"]).params == {}


def test_fences_cap_and_remove(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame([(v, 1.0) for v in vals], "x double, k double")
    f = fit.fit_fences(df, ["x", "k"])
    q1, q3 = np.quantile([1, 2, 3, 4, 100], [0.25, 0.75])
    assert f.bounds["x"] == pytest.approx((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    assert "k" not in f.bounds                                # IQR 0: no fence
    capped = [r["x"] for r in f.cap(df).collect()]
    assert capped[4] == pytest.approx(q3 + 1.5 * (q3 - q1)) and capped[5] is None
    assert f.remove(df).count() == 4                          # outlier and NULL removed


def test_ln_gate(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (np.e, 1.0, None)], "a double, b double, c double")
    out, done, skipped = fit.ln_transform(df, ["a", "b", "c"])
    assert done == ["a"] and skipped == ["b", "c"]
    assert [r["a"] for r in out.collect()] == pytest.approx([0.0, 1.0])


def test_one_hot(spark):
    df = spark.createDataFrame([("x", 2, "p"), ("y", 10, None), (None, 1, "p")], "s string, n int, t string")
    m = fit.fit_one_hot(df)                                    # all text columns
    out = m.transform(df)
    assert out.columns == ["n", "s_x", "s_y", "t_p"]
    assert [tuple(r) for r in out.collect()] == [(2, 1, 0, 1), (10, 0, 1, 0), (1, 0, 0, 1)]
    keep = fit.fit_one_hot(df, ["n"], keep_source=True).transform(df)
    assert keep.columns == ["s", "n", "t", "n_is_1", "n_is_2", "n_is_10"]   # sorted as numbers
    with pytest.raises(ValueError):
        fit.fit_one_hot(df, ["s"], max_levels=1)


def test_impute_mode_of_categorical_integer(spark):
    from curata.operators.clean import cast_columns
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    cat, _, _ = cast_columns(df, ["k"], "category")
    m = fit.fit_impute(cat, "mean")
    out = m.transform(cat)
    assert m.categorical_fill == {"k": 2} and dict(out.dtypes)["k"] == "int"
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 2, 2]


def test_mode_tie_of_numbers(spark):
    from curata.operators.clean import cast_columns
    df = spark.createDataFrame([(10,), (2,), (None,)], "k int")
    m = fit.fit_impute(cast_columns(df, ["k"], "category")[0], "mean")
    assert m.categorical_fill == {"k": 2}


def test_one_hot_keep_of_doubles(spark):
    nan = float("nan")
    df = spark.createDataFrame([(10000000.0,), (0.0001,), (nan,), (None,), (-0.0,), (0.0,)], "a double")
    out = fit.fit_one_hot(df, ["a"], keep_source=True).transform(df)
    assert out.columns == ["a", "a_is_0_0", "a_is_0_0001", "a_is_10000000_0"]
    assert [tuple(r)[1:] for r in out.collect()] == [(False, False, True), (False, True, False), (False, False, False),
                                                     (False, False, False), (True, False, False), (True, False, False)]


def test_fences_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = formatted_plan(fit.Fences({"value": (1.0, 50.0)}).remove(df))
    assert "GreaterThanOrEqual(value,1.0)" in plan and "LessThanOrEqual(value,50.0)" in plan
