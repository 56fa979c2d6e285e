"""The density's Gauss transform against a kernel for every row."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import formatted_plan
from curata.operators.plotdata import _hermite, density, series_error


def samples():
    rng = np.random.default_rng(3)
    return {"normal": rng.normal(40, 7, 900), "tails": rng.standard_cauchy(900), "far": np.r_[rng.normal(0, 1e-3, 500), rng.normal(1000, 5, 400)],
            "uniform": rng.uniform(-1, 1, 900), "two": np.array([1.0, 2.0])}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g, float(x)) for g, xs in samples().items() for x in xs] + [(None, float(i)) for i in range(40)] + [("one", 5.0), ("two", None)]
    return spark.createDataFrame(rows, "g string, x double").repartition(4).cache()


def test_series_bound():
    assert series_error() < 1e-11
    assert _hermite(5) == [[1], [0, 1], [-1, 0, 1], [0, -3, 0, 1], [3, 0, -6, 0, 1]]


@pytest.mark.parametrize("adjust", [1.0, 0.1, 4.0])
def test_within_the_stated_bound(table, adjust):
    exact = {(r["g"], r["point"]): r for r in density(table, "x", "g", adjust, collapse=False).collect()}
    fast = {(r["g"], r["point"]): r for r in density(table, "x", "g", adjust, series=True).collect()}
    assert fast.keys() == exact.keys() and len(fast) == 200 * 6
    for g in {g for g, _ in fast}:
        xs = list(samples().get(g, range(40)))
        peak = 1 / (statistics.stdev(xs) * len(xs) ** -0.2 * adjust * math.sqrt(2 * math.pi))
        worst = max(abs(fast[k]["density"] - exact[k]["density"]) for k in fast if k[0] == g)
        assert worst <= 1e-10 * peak, (g, worst / peak)
        assert all(fast[k]["x"] == exact[k]["x"] and fast[k]["density"] >= 0 for k in fast if k[0] == g)


def test_without_groups_and_empty(spark, table):
    one = table.where(F.col("g") == "normal")
    a, b = density(one, "x", series=True).collect(), density(one, "x", collapse=False).collect()
    assert len(a) == 200 and max(abs(p["density"] - q["density"]) for p, q in zip(a, b)) < 1e-10
    assert density(spark.createDataFrame([], "x double"), "x", series=True).collect() == []


def test_rows_meet_no_grid_points(table):
    """Grid points are listed beside a cell's coefficients, and no value is."""
    plan = formatted_plan(density(table, "x", "g", series=True))
    lists = [b for b in plan.split("\n\n") if ") Generate" in b.split("\n")[0]]
    assert any("_b11#" in b for b in lists) and not any("_x#" in b for b in lists)
