import numpy as np
import pytest

from curata.operators import corr, plotdata


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=400)
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    h = plotdata.histogram(df, "x", 12).collect()
    counts, edges = np.histogram(vals, bins=12)
    assert [r["count"] for r in h] == list(counts)
    assert [r["bin_lo"] for r in h] == pytest.approx(list(edges[:-1]))
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    hc = plotdata.histogram(const, "x", 4).collect()
    assert hc[0]["bin_lo"] == 1.5 and hc[-1]["bin_hi"] == 2.5 and sum(r["count"] for r in hc) == 2


def test_histogram_by_group_shares_edges(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 10.0), (None, 5.0)], "g string, x double")
    h = plotdata.histogram(df, "x", 5, group_by="g").collect()
    assert len(h) == 15 and {r["g"] for r in h} == {"a", "b", "(Missing)"}
    assert sum(r["count"] for r in h) == 4


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 300)] + [("b", float(v)) for v in rng.normal(5, 2, 200)]
    rows += [("c", 1.0), ("d", 3.0), ("d", 3.0)]               # no density: n < 2 / zero variance
    d = plotdata.density(spark.createDataFrame(rows, "g string, x double"), "x", "g").toPandas()
    assert set(d.g) == {"a", "b"}
    for g, part in d.groupby("g"):
        part = part.sort_values("point")
        assert len(part) == 200
        assert np.trapezoid(part.density, part.x) == pytest.approx(1.0, abs=2e-3)
    # against a direct evaluation of the Gaussian kernel sum
    a = np.array([v for g, v in rows if g == "a"])
    bw = a.std(ddof=1) * len(a) ** -0.2
    pa = d[d.g == "a"].sort_values("point")
    x0 = pa.x.iloc[57]
    direct = np.exp(-0.5 * ((x0 - a) / bw) ** 2).sum() / (len(a) * bw * np.sqrt(2 * np.pi))
    assert pa.density.iloc[57] == pytest.approx(direct)


def test_density_paths_agree(spark):
    # repeated values (auto: collapsed) and a near-unique group, both paths forced
    rows = [("r", float(v % 7)) for v in range(400)] + [("u", v * 0.37) for v in range(300)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {}
    for how in (None, True, False):
        pdf = plotdata.density(df, "x", "g", collapse=how).toPandas()
        got[how] = pdf.sort_values(["g", "point"]).reset_index(drop=True)
    for how in (True, False):
        assert (got[how][["g", "point"]] == got[None][["g", "point"]]).all().all()
        np.testing.assert_allclose(got[how].density, got[None].density, rtol=1e-12, atol=1e-15)
        np.testing.assert_allclose(got[how].x, got[None].x, rtol=0, atol=0)


def test_box_stats(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 50.0, -40.0]
    df = spark.createDataFrame([("k", v) for v in vals] + [("k", None)], "g string, y double")
    b = plotdata.box_stats(df, "y", "g").first()
    q1, med, q3 = np.quantile(vals, [0.25, 0.5, 0.75])
    assert (b["q1"], b["median"], b["q3"]) == pytest.approx((q1, med, q3))
    assert (b["whisker_low"], b["whisker_high"], b["n_outliers"], b["n"]) == (1.0, 6.0, 2, 8)
    out = sorted(r["y"] for r in plotdata.box_outliers(df, "y", "g").collect())
    assert out == [-40.0, 50.0]


def test_bar_line_datetime(spark):
    df = spark.createDataFrame([("2024-01-02", 1.0, "a"), ("2024-01-02", 3.0, "a"), ("2024-01-01", 5.0, None),
                                ("bad", 1.0, "a"), ("2024-01-03", None, "b")], "d string, y double, c string")
    bar = plotdata.bar_counts(df, "c").collect()
    assert [(r["category"], r["count"]) for r in bar] == [("a", 3), ("(Missing)", 1), ("b", 1)]
    assert plotdata.is_datetime_like(df, "d")                        # 4 of 5 parse
    line = plotdata.line_series(df, "d", "y").collect()
    assert [r["y_mean"] for r in line] == [5.0, 2.0]
    rep = {r["column"]: r for r in plotdata.datetime_report(df).collect()}
    assert rep["d"]["parsed_share"] == 0.8 and rep["d"]["is_datetime"] and not rep["c"]["is_datetime"]


def test_correlation_and_regression(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    y = 2 * x + rng.normal(size=200)
    rows = [(float(a), float(b), 1.0) for a, b in zip(x, y)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, k double")
    c = {(r["var_y"], r["var_x"]): r["corr"] for r in corr.correlation_matrix(df, ["x", "y", "k"]).collect()}
    assert c[("y", "x")] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert c[("k", "x")] is None                                      # constant: undefined, no error
    reg = corr.pair_regression(df, ["x", "y"]).first()
    slope, intercept = np.polyfit(x, y, 1)
    assert (reg["slope"], reg["intercept"]) == pytest.approx((slope, intercept))
    sm = corr.scatter_matrix_data(df, ["x", "y"])
    assert sm["histograms"].count() == 36 and sm["correlations"].count() == 1
    with pytest.raises(ValueError):
        corr.scatter_matrix_data(df, [])


def test_datetime_columns_and_points(spark):
    df = spark.createDataFrame([("2024-01-02", 1.0, "a"), ("2024-02-01", None, None)], "d string, y double, c string")
    assert plotdata.datetime_columns(df) == ["d"]
    assert plotdata.line_x_choices(df) == ["d", "y"]
    pts = plotdata.box_points(df, "y", "c").collect()
    assert [(r["c"], r["y"]) for r in pts] == [("a", 1.0)]


@pytest.mark.parametrize("values, bins", [([i / 100 for i in range(11)], 30), ([i / 100 for i in range(101)], 100), ([0.1 * i for i in range(50)], 7)])
def test_histogram_of_values_on_edges(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    counts, edges = np.histogram(values, bins=bins)
    got = plotdata.histogram(df, "x", bins).collect()
    assert [r["count"] for r in got] == list(counts)
    many = corr.scatter_matrix_data(df.withColumn("y", df["x"] * 2), ["x", "y"])["histograms"].where("variable = 'x'")
    assert [r["count"] for r in many.orderBy("bin").collect()] == list(np.histogram(values, bins=18)[0])


def test_histogram_of_discount_is_numpys(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got = [r["count"] for r in plotdata.histogram(df, "l_discount", 30).collect()]
    assert got == list(np.histogram(df.select("l_discount").toPandas()["l_discount"], bins=30)[0])


def test_histogram_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert [r["count"] for r in plotdata.histogram(df, "x", 3).collect()] == [0, 0, 0]


def test_group_columns_named_like_results(spark):
    df = spark.createDataFrame([("a", "u", 1.0, 2.0), ("b", "u", 2.0, 3.0), ("b", "v", 4.0, 5.0), ("b", "v", 4.5, 1.0)], "bin string, x string, group double, y double")
    h = plotdata.histogram(df, "y", 2, group_by="bin")
    assert h.columns == ["bin_group", "bin", "bin_lo", "bin_hi", "count"] and h.count() == 4
    assert plotdata.line_series(df, "group", "y").columns == ["group", "y_mean", "n"]
    d = plotdata.density(df, "y", group_by="x")
    assert d.columns == ["x_group", "point", "x", "density"]


def test_density_window_adds_what_all_points_would(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(0, 0.01, 300), [1000.0, -1000.0]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = plotdata.density(df, "x", bw_adjust=0.1).orderBy("point").toPandas()
    n, bw = len(vals), vals.std(ddof=1) * len(vals) ** -0.2 * 0.1
    want = np.exp(-0.5 * ((got.x.to_numpy()[:, None] - vals) / bw) ** 2).sum(1) / (n * bw * np.sqrt(2 * np.pi))
    assert len(got) == 200 and (got.density == 0).any()
    np.testing.assert_allclose(got.density, want, rtol=1e-9, atol=1e-300)


def test_no_cached_entries_are_left(spark):
    df = spark.createDataFrame([("k", float(v)) for v in range(50)], "g string, y double")
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for out in (plotdata.box_stats(df, "y", "g"), plotdata.density(df, "y", "g"), corr.scatter_matrix_table(df, ["y"])):
        out.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_histograms_of_many_columns_read_the_data_once_after_the_range(spark, tmp_path):
    from conftest import formatted_plan
    path = str(tmp_path / "t")
    spark.range(50).selectExpr("id * 1.0 as a", "id * 2.0 as b", "cast(null as double) as c").write.parquet(path)
    out = plotdata.histograms(spark.read.parquet(path), ["a", "b", "c"], 4)
    assert formatted_plan(out).count("Scan parquet") <= 2  # the node and its details
    rows = out.collect()
    assert [r["count"] for r in rows if r["variable"] == "b"] == [13, 12, 12, 13]
    assert [r["count"] for r in rows if r["variable"] == "c"] == [0, 0, 0, 0]
