import pytest
from pyspark.sql import functions as F

from curata.operators.features import FeatureRules, make_log2_rule
from curata.operators.filters import DropRule
from curata.plans.recipe import CleaningRecipe
from curata.plans.workflow import prepare
from curata.streaming import clean_stream


@pytest.fixture()
def raw(spark):
    rows = [(1, " A ", 10.0, "x"), (1, " A ", 10.0, "x"), (2, "B", None, None), (3, "C", 1000.0, "y"),
            (4, "B", 12.0, "x"), (5, "A", 11.0, "y"), (6, "C", 9.0, "x")]
    return spark.createDataFrame(rows, "`Order Key` int, `Group Name` string, `Price ($)` double, Tag string")


def test_recipe_order_and_log(spark, raw):
    recipe = CleaningRecipe(remove_duplicates=True, missing_strategy="median_mode",
                            handle_outliers=True, outlier_action="remove", outlier_cols=("Price ($)",),
                            drop_rules=(DropRule("Group Name", ("C",)),))
    out, log = recipe.apply(raw)
    assert out.columns == ["order_key", "group_name", "price_", "tag"]
    rows = sorted((r["order_key"], r["group_name"], r["price_"], r["tag"]) for r in out.collect())
    # dedup -> 6 rows; median of 10, 1000, 12, 11, 9 = 11 fills key 2; mode of tag = x;
    # fences from 9, 10, 11, 11, 12, 1000 drop 1000; rule drops group C
    assert rows == [(1, "A", 10.0, "x"), (2, "B", 11.0, "x"), (4, "B", 12.0, "x"), (5, "A", 11.0, "y")]
    removed = {r["step"]: r["rows_removed"] for r in log.to_dataframe(spark).collect()}
    assert removed["dedup"] == 1 and removed["outliers"] == 1 and removed["drop_values"] == 1 and removed["trim"] is None
    assert log.lines()[-1] == "result: 4 row(s), 4 column(s)"


def test_log_counts_come_from_the_action(spark, raw):
    """Rendering starts no job once the result has been computed; before, one."""
    recipe = CleaningRecipe(remove_duplicates=True, drop_rules=(DropRule("Group Name", ("C",)),))
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(group, act):
        sc.setJobGroup(group, group)
        act()
        sc.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    out, log = recipe.apply(raw)
    out.write.format("noop").mode("overwrite").save()
    assert jobs("after", log.lines) == 0
    assert [r.text(log.removed(r)) for r in log.records if r.rows_after is not None] == [
        "dedup: changed - 1 row(s) fewer", "drop_values: changed (values C) - group_name - 2 row(s) fewer"]
    _, unused = recipe.apply(raw)
    assert jobs("before", unused.lines) > 0 and unused.lines() == log.lines()


def test_ln_of_a_boolean_column(spark):
    df = spark.createDataFrame([(True, 1.0), (True, 2.0)], "flag boolean, x double")
    out, log = CleaningRecipe(apply_log=True, log_cols=("flag", "x")).apply(df)
    assert sorted(r["flag"] for r in out.collect()) == [0.0, 0.0]


def test_one_hot_of_many_levels(spark):
    from curata.operators import fit
    from curata.operators.features import make_one_hot_rule
    df = spark.range(1200).selectExpr("cast(id as string) as s")
    assert len(fit.fit_one_hot(df).levels["s"]) == 1200
    assert len(make_one_hot_rule(df, "s").levels) == 1200
    out, _ = CleaningRecipe(encode_categorical=True).apply(df)
    assert len(out.columns) == 1200


def test_rule_toggles(spark, raw):
    r = CleaningRecipe().with_rule(DropRule("Tag", ("x",))).with_rule(DropRule("Tag", ("y",)))
    assert r.apply(raw)[0].count() == 1
    assert r.toggled(1, False).apply(raw)[0].count() == 3
    assert r.without_rule(0).apply(raw)[0].count() == 5


def test_fitted_replays_on_other_table_and_stream(spark, raw, tmp_path):
    recipe = CleaningRecipe(missing_strategy="mean_mode", scaling_method="minmax", scale_cols=("Price ($)",))
    fitted = recipe.fit(raw)
    batch = fitted.transform(raw).orderBy("order_key").collect()
    assert batch[0]["price_"] == pytest.approx((10.0 - 9.0) / (1000.0 - 9.0))
    src = tmp_path / "in"
    raw.write.parquet(str(src))
    stream = spark.readStream.schema(raw.schema).parquet(str(src))
    cleaned = clean_stream(stream, fitted, FeatureRules(logs=[make_log2_rule("price_", "lp")]))
    q = cleaned.writeStream.format("memory").queryName("cleaned_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM cleaned_stream").orderBy("order_key", "price_").collect()
    assert [r["price_"] for r in got] == pytest.approx([r["price_"] for r in batch])
    assert "lp" in got[0].asDict()


def test_prepare_workflow(spark, raw):
    p = prepare(raw, CleaningRecipe(remove_duplicates=True), FeatureRules(logs=[make_log2_rule("price_", "lp")]))
    assert p.features.columns[-1] == "lp" and p.cleaned.count() == 6 and p.rule_errors == []


def test_stream_dedup_within_watermark(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "k int, s string, t string").withColumn("t", F.col("t").cast("timestamp"))
    fitted = CleaningRecipe(remove_duplicates=True).fit(df)
    src = tmp_path / "ev"
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    out = clean_stream(stream, fitted, event_time="t", delay="1 hour")
    q = out.writeStream.format("memory").queryName("dedup_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM dedup_stream").count() == 2
    with pytest.raises(ValueError):
        clean_stream(stream, fitted)
