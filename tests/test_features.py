import pytest

from curata.operators.features import (FeatureRules, MapRule, apply_bin, apply_log2, apply_map_rules,
                                       bin_labels, make_bin_rule, make_log2_rule, make_map_rule,
                                       make_one_hot_rule, parse_value)


def test_parse_value():
    assert parse_value(" TRUE ") is True
    assert parse_value("3.0") == 3 and isinstance(parse_value("3.0"), int)
    assert parse_value("2.5") == 2.5
    assert parse_value("high") == "high"
    with pytest.raises(ValueError):
        parse_value("inf")


def test_map_rules_last_wins_and_keep(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (9.0,), (None,)], "x double")
    rules = [MapRule("x", ">", 2.0, "band", "mid"), MapRule("x", ">", 6.0, "band", "top")]
    out = apply_map_rules(df, rules)
    assert [r["band"] for r in out.collect()] == [None, "mid", "top", None]
    assert out.schema["band"].metadata["curata_role"] == "categorical"
    mixed = apply_map_rules(df, [MapRule("x", "=", 1.0, "m", 1), MapRule("x", "=", 5.0, "m", "five")])
    assert [r["m"] for r in mixed.collect()] == ["1", "five", None, None]
    r = make_map_rule(df, "x", "<", "median", "low", "yes")
    assert r.threshold == 5.0 and r.true_value == "yes"
    with pytest.raises(ValueError):
        make_map_rule(df, "x", "<", "mean", "bad name", "1")


def test_bins(spark):
    assert bin_labels([13, 20, 30], True) == ["13-20", "21-30"]
    assert bin_labels([13, 20, 30], False) == ["13.0-20.0", "20.0-30.0"]
    df = spark.createDataFrame([(v,) for v in [1, 10, 11, 20, 21, 50, None]], "p int")
    rule = make_bin_rule(df, "p", "20, 10, 10", "pb")
    assert rule.edges == (1.0, 10.0, 20.0, 50.0)
    out = apply_bin(df, rule)
    assert [r["pb"] for r in out.collect()] == ["1-10", "1-10", "11-20", "11-20", "21-50", "21-50", None]
    assert out.schema["pb"].metadata["curata_levels"] == ["1-10", "11-20", "21-50"]
    with pytest.raises(ValueError):
        make_bin_rule(df, "p", [50], "pb")                     # not strictly inside
    with pytest.raises(ValueError):
        make_bin_rule(df, "p", [20.2, 20.5, 20.7], "pb")        # repeated labels


def test_log2_and_rules(spark):
    df = spark.createDataFrame([(8.0, "a"), (0.0, "b"), (-1.0, None), (None, "a")], "x double, s string")
    out = apply_log2(df, make_log2_rule("x", "x_log2"))
    assert [r["x_log2"] for r in out.collect()] == [3.0, None, None, None]
    rules = FeatureRules(maps=[MapRule("x", ">", 1.0, "big", True)],
                         bins=[make_bin_rule(df, "x", [1], "xb")],
                         one_hots=[make_one_hot_rule(df, "s")],
                         logs=[make_log2_rule("x", "lx"), make_log2_rule("gone", "ly")])
    res, errors = rules.apply(df)
    assert res.columns == ["x", "s", "big", "xb", "s_is_a", "s_is_b", "lx"]
    assert len(errors) == 1 and "gone" in errors[0]
    with pytest.raises(ValueError):
        make_one_hot_rule(df, "s", existing=rules.one_hots)


def test_map_rules_see_earlier_targets(spark):
    df = spark.createDataFrame([(50.0,), (200.0,), (5.0,)], "p double")
    out = apply_map_rules(df, [MapRule("p", ">", 100.0, "p", 5), MapRule("p", "<", 10.0, "flag", "low")])
    assert [tuple(r) for r in out.collect()] == [(50.0, None), (5.0, "low"), (5.0, "low")]
    assert "curata_role" not in out.schema["p"].metadata and out.schema["flag"].metadata["curata_role"] == "categorical"


def test_bad_map_rule_is_told(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    out, errors = FeatureRules(maps=[MapRule("x", ">", 0.0, "a", "y"), MapRule("gone", ">", 0.0, "b", "y")]).apply(df)
    assert out.columns == ["x", "a"] and len(errors) == 1 and "gone" in errors[0]
