"""Correlations and regressions of many columns, against few at a time."""

import numpy as np
import pandas as pd
import pytest

from curata.operators import corr

N = 300


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, N)) @ (np.eye(N) + 0.2 * rng.standard_normal((N, N))) + 1e6
    x[:, 7] = 0.1                                  # one value: undefined
    x[:, 8] = 2 * x[:, 9] - 5
    x[::50, 10] = np.nan                           # these rows are left out
    return pd.DataFrame(x, columns=[f"x {i}" for i in range(N)])


def test_three_hundred_columns_in_one_pass(spark, frame):
    df = spark.createDataFrame(frame).repartition(7)
    rows = corr.correlation_matrix(df, list(frame.columns)).collect()
    full = frame.dropna()
    want = full.corr().to_numpy()
    assert len(rows) == N * (N - 1) // 2 and {r["n"] for r in rows} == {len(full)}
    place = {c: i for i, c in enumerate(frame.columns)}
    for r in rows:
        i, j = place[r["var_y"]], place[r["var_x"]]
        assert i > j
        if 7 in (i, j):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(want[i, j], abs=1e-9)


def test_regressions_equal_those_of_few_columns(spark, frame):
    cols = [f"x {i}" for i in range(corr.PAIR_COLUMNS + 6)]
    df = spark.createDataFrame(frame[cols].dropna()).repartition(5)
    wide = {(r["var_y"], r["var_x"]): r for r in corr.pair_regression(df, cols).collect()}
    some = cols[5:12]
    for r in corr.pair_regression(df, some).collect():
        w = wide[r["var_y"], r["var_x"]]
        assert w["n"] == r["n"]
        if r["slope"] is None:
            assert w["slope"] is None and w["intercept"] is None
        else:
            assert w["slope"] == pytest.approx(r["slope"], rel=1e-7, abs=1e-9) and w["intercept"] == pytest.approx(r["intercept"], rel=1e-7)


def test_one_row_and_none(spark):
    cols = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([tuple(float(i) for i in range(30))], [*cols])
    for data, n in ((df, 1), (df.limit(0), 0)):
        rows = corr.correlation_matrix(data, cols).collect()
        assert len(rows) == 435 and {(r["corr"], r["n"]) for r in rows} == {(None, n)}
        assert {(r["slope"], r["intercept"]) for r in corr.pair_regression(data, cols).collect()} == {(None, None)}
