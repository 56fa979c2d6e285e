import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from curata.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def _expected(values, probs):
    vals = [v for v in values if v is not None and not np.isnan(v)]
    if not vals:
        return [None] * len(probs)
    return [float(np.quantile(np.array(vals), p)) for p in probs]


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_matches_numpy_per_group(spark, limit):
    rng = np.random.default_rng(7)
    rows = []
    for g, n in [("big", 500), ("small", 3), ("one", 1)]:
        for v in rng.normal(size=n).round(2):     # many ties
            rows.append((g, float(v)))
    rows += [("big", None), ("nan", float("nan")), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: [r[f"q{i}"] for i in range(len(PROBS))]
           for r in exact_quantiles(df, ["g"], "v", PROBS, exact_limit=limit, buckets=8).collect()}
    for g in ["big", "small", "one", None, "nan"]:
        exp = _expected([v for gg, v in rows if gg == g], PROBS)
        assert got[g] == pytest.approx(exp) if exp[0] is not None else got[g] == exp


def test_skewed_distribution_refines(spark):
    vals = [0.0] * 300 + [1e-9 * i for i in range(200)] + [1e12]
    df = spark.createDataFrame([(v,) for v in vals], "v double").selectExpr("1 AS g", "v")
    r = exact_quantiles(df, ["g"], "v", PROBS, exact_limit=5, buckets=4).first()
    assert [r[f"q{i}"] for i in range(5)] == pytest.approx(_expected(vals, PROBS))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_property_integers(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "v double").selectExpr("'k' AS g", "v")
    r = exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], exact_limit=4, buckets=3).first()
    assert [r["q0"], r["q1"], r["q2"]] == pytest.approx(_expected(xs, [0.1, 0.5, 0.9]))


def test_octave_bucket_is_monotone_on_awkward_doubles(spark):
    import math
    from curata.operators.quantiles import with_octave_bucket
    vals = {0.0, 5e-324, 1.7976931348623157e308}
    for k in range(-1074, 1024, 3):
        p = math.ldexp(1.0, k)
        for x in (p, math.nextafter(p, 0), math.nextafter(p, math.inf), p * 1.5):
            if math.isfinite(x):
                vals.update((x, -x))
    df = spark.createDataFrame([(v,) for v in sorted(vals)], "_v double")
    rows = with_octave_bucket(df).orderBy("_v").collect()
    assert all(a["_bk"] <= b["_bk"] for a, b in zip(rows, rows[1:]))
    assert all(r["_bk"] is not None for r in rows)
