"""Registered queries: one per operator group of the inventory, each reading
the given tables (or tables Spark derives from them) in full.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the oracle SQL in ``curata.oracle``. Floating results that go
through sums in a different order in another engine are rounded half-even to a
stated number of digits, the way the reference rounds its summaries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import zero_sign
from .operators import clean, corr, fit, plotdata, summary
from .operators.features import (FeatureRules, apply_bin, apply_log2, apply_map_rules,
                                  make_bin_rule, make_log2_rule, make_map_rule,
                                  make_one_hot_rule)
from .operators.filters import (DropRule, RangeFilter, ValueFilter, filter_all,
                                filter_status, parse_drop_rule)
from .plans.recipe import CleaningRecipe
from .plans.workflow import prepare_file
from .session import scratch_path
from .sources import dirty_orders, load_table, normalize_types, number_rows, preview, read_csv, read_json, read_parquet, table, write_csv, write_csv_file, write_json_array

LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rnd(c: Column | str, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return zero_sign(F.bround(c, digits))


def _round_cols(df: DataFrame, cols: dict[str, int]) -> DataFrame:
    return df.select(*[rnd(F.col(f"`{c}`"), cols[c]).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


# ------------------------------------------------------------- summaries

def q_num_summary(spark, sf):
    return summary.numerical_summary(table(spark, sf, "lineitem"), LINE_NUMS)


def q_num_summary_grouped(spark, sf):
    return summary.numerical_summary(table(spark, sf, "lineitem"), LINE_NUMS,
                                     ["l_returnflag", "l_linestatus"])


def summary_filters():
    return [RangeFilter("Total-Price ($)", 50000.0, 400000.0),
            ValueFilter("Priority", ("1-URGENT", "2-HIGH"), include_missing=True)]


def q_num_summary_filtered(spark, sf):
    d = filter_all(dirty_orders(spark, sf), summary_filters())
    return summary.numerical_summary(d, ["Total-Price ($)", "Sparse"], ["Priority"])


def q_num_summary_levels(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    binned = apply_bin(li, make_bin_rule(li, "l_quantity", [10, 10.5, 20], "qty_bin"))
    return summary.numerical_summary(binned, ["l_extendedprice"], ["qty_bin"])


def q_num_summary_missing_level(spark, sf):
    """Bins frozen on the orders under 300,000: the others have a missing bin."""
    o = table(spark, sf, "orders").select("o_totalprice")
    rule = make_bin_rule(o.where("o_totalprice < 300000"), "o_totalprice", [100000, 200000], "price_bin")
    return summary.numerical_summary(apply_bin(o, rule), ["o_totalprice"], ["price_bin"]).where("price_bin is null or count > 0").drop("price_bin")


def q_stat_select(spark, sf):
    return summary.numerical_summary(table(spark, sf, "lineitem"), LINE_NUMS, ["l_returnflag"], stats=["max", "Q1", "count"])


def q_cat_stat_select(spark, sf):
    return summary.categorical_summary(dirty_orders(spark, sf), "Priority", stats=["percentage"])


def q_distinct_missing(spark, sf):
    d = dirty_orders(spark, sf)
    rows = [(c, summary.distinct_count(d, c), summary.distinct_count(d, c, missing_as_value=True)) for c in ("Priority", "Status")]
    return spark.createDataFrame(rows, "column string, n_distinct long, n_with_missing long")


def q_preview(spark, sf):
    return preview(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 5, "o_orderkey")


def q_preview_head(spark, sf):
    """The first rows of the file, as they stand in it."""
    o = read_parquet(spark, f"{sf}/orders.parquet", position="at")
    return preview(o.select("o_orderkey", "o_totalprice", "at"), 5, "at")


def q_row_numbers(spark, sf):
    c = read_parquet(spark, f"{sf}/customer.parquet", position="at")
    return number_rows(c.select("c_custkey", "at"), "at", "row_number")


def q_onehot_first_seen(spark, sf):
    """Columns in order of first appearance, with the rows that each marks."""
    o = read_parquet(spark, f"{sf}/orders.parquet", position="at").select("o_orderkey", "o_orderpriority", "at")
    out = make_one_hot_rule(o, "o_orderpriority", order_by="at").apply(o)
    new = [c for c in out.columns if c not in o.columns]
    one = out.agg(*[F.count_if(F.col(f"`{c}`")).alias(c) for c in new])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n"))
                                         for i, c in enumerate(new)])))


def q_datetime_first_cells(spark, sf):
    """Whether text is time by its first 200 cells: in one column the first
    rows are no times, in the other the first 300 are and all else is not."""
    e = read_parquet(spark, f"{sf}/events.parquet", position="at").select("event_id", "at")
    late = F.when(F.col("at.row") < 100, "none").otherwise("2024-05-06 07:08:09")
    early = F.when(F.col("at.row") < 300, F.when(F.col("at.row") % 3 > 0, "2024-05-06")).otherwise("none")
    rows = e.select("at", late.alias("late"), early.alias("early"))
    return plotdata.datetime_report(rows, ["late", "early"], order_by="at")


def q_filter_status(spark, sf):
    return filter_status(dirty_orders(spark, sf), summary_filters())


def q_cat_summary(spark, sf):
    return summary.categorical_summary(table(spark, sf, "orders"), "o_orderpriority")


def q_cat_top_n(spark, sf):
    return summary.categorical_summary(table(spark, sf, "part"), "p_type", top_n=3)


def q_cat_summary_missing(spark, sf):
    return summary.categorical_summary(dirty_orders(spark, sf), "Priority")


def q_missing_table(spark, sf):
    return summary.missing_summary(dirty_orders(spark, sf))


def q_overview(spark, sf):
    d = dirty_orders(spark, sf)
    cleaned, _ = CleaningRecipe(remove_duplicates=True).apply(d)
    return summary.dataset_overview(d, cleaned)


def q_filter_bounds(spark, sf):
    return _round_cols(summary.filter_bounds(dirty_orders(spark, sf)), {})


def q_filter_choices(spark, sf):
    return summary.filter_choices(dirty_orders(spark, sf), "Priority").drop("value")


def q_column_facts(spark, sf):
    f = summary.column_facts(table(spark, sf, "customer"), "c_acctbal")
    return _round_cols(f, {"mean": 6, "median": 6})


# ------------------------------------------------------------- cleaning

def q_trim_names(spark, sf):
    out, _ = CleaningRecipe().apply(dirty_orders(spark, sf))
    return out


def q_dedup(spark, sf):
    out, _ = CleaningRecipe(remove_duplicates=True).apply(dirty_orders(spark, sf))
    return out


def q_drop_rows_missing(spark, sf):
    return clean.drop_rows_missing(dirty_orders(spark, sf), 20)


def q_drop_cols_missing(spark, sf):
    return clean.drop_cols_missing(dirty_orders(spark, sf), 50)[0]


def _impute(spark, sf, method):
    d = dirty_orders(spark, sf)
    out = fit.fit_impute(d, method).transform(d)
    return _round_cols(out, {"Total-Price ($)": 6, "Sparse": 6})


def q_impute_mean(spark, sf):
    return _impute(spark, sf, "mean")


def q_impute_median(spark, sf):
    return _impute(spark, sf, "median")


def q_cast_int(spark, sf):
    d = dirty_orders(spark, sf).select("`Order Key`", "`Code Text`", "`Bad Code`")
    return clean.cast_columns(d, ["Code Text", "Bad Code"], "integer")[0]


def q_cast_float(spark, sf):
    d = dirty_orders(spark, sf).select("`Order Key`", "`Code Text`", "Status")
    return clean.cast_columns(d, ["Code Text", "Status"], "float")[0]


def q_cast_text(spark, sf):
    d = dirty_orders(spark, sf).select("`Order Key`", "Sparse", "Priority")
    return clean.cast_columns(d, ["Order Key", "Sparse"], "string")[0]


def _scale(spark, sf, method):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    out = fit.fit_scale(p, ["p_size", "p_retailprice"], method).transform(p)
    return _round_cols(out, {"p_size": 9, "p_retailprice": 9})


def q_scale_z(spark, sf):
    return _scale(spark, sf, "standard")


def q_scale_minmax(spark, sf):
    return _scale(spark, sf, "minmax")


def q_onehot_replace(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return fit.fit_one_hot(e).transform(e)


def q_onehot_keep(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return make_one_hot_rule(c, "c_mktsegment").apply(c)


def q_ln_gate(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE_NUMS[:3])
    out, _, _ = fit.ln_transform(li, ["l_quantity", "l_extendedprice", "l_discount"])
    return _round_cols(out, {"l_quantity": 9, "l_extendedprice": 9})


def _outliers(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return e, fit.fit_fences(e, ["value"], 1.5)


def q_outlier_cap(spark, sf):
    e, fences = _outliers(spark, sf)
    return _round_cols(fences.cap(e), {"value": 6})


def q_outlier_remove(spark, sf):
    e, fences = _outliers(spark, sf)
    return fences.remove(e)


def q_drop_values(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority",
                                          "o_totalprice")
    recipe = (CleaningRecipe(standardize_names=False, trim_strings=False)
              .with_rule(DropRule("o_orderpriority", ("1-URGENT", "2-HIGH")))
              .with_rule(DropRule("o_orderstatus", ("P",)))
              .with_rule(DropRule("o_totalprice", ("5.0", "nan"))))
    return recipe.apply(o)[0]


def _noted_orders(spark, sf):
    """Dirty orders with a text column of quotes, commas and line ends."""
    k = F.col("`Order Key`")
    note = (F.when(k % 4 == 0, F.concat(F.lit('say "hi", no. '), k.cast("string")))
            .when(k % 4 == 1, F.concat(F.lit("two\nlines "), k.cast("string")))
            .when(k % 4 == 2, F.lit('"quoted"')).otherwise(F.lit("a,b")))
    return dirty_orders(spark, sf).withColumn("Note", note)


def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    write_csv(_noted_orders(spark, sf), path)
    return read_csv(spark, path)


def q_csv_file(spark, sf):
    """Orders as one CSV file, last key first, read again with the row of each."""
    path = scratch_path(spark, "one") + ".csv"
    k = F.col("o_orderkey")
    note = F.when(k % 2 == 0, F.concat(F.lit('say "hi",\n'), "o_orderstatus")).otherwise(F.lit("a,b"))
    o = table(spark, sf, "orders").select((-k).alias("last first"), k.alias("key"), note.alias("note"))
    write_csv_file(o, path, order_by="last first")
    return number_rows(read_csv(spark, path, position="at"), "at", "row_number")


def q_json_roundtrip(spark, sf):
    """Customers as JSON lines, orders as arrays (one a file)."""
    lines, array = scratch_path(spark, "lines"), scratch_path(spark, "array")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).write.json(lines)
    write_json_array(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name")), array)
    return read_json(spark, lines).select(F.lit("lines").alias("layout"), "key", "name").unionByName(
        read_json(spark, array).select(F.lit("array").alias("layout"), "key", "name"))


def q_load_dispatch(spark, sf):
    path = scratch_path(spark, "load")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    write_csv(rows, path + ".csv")
    rows.write.json(path + ".JSON")
    rows.write.parquet(path + ".parquet")
    parts = [load_table(spark, path + suffix).select(F.lit(suffix).alias("suffix"), F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")
             for suffix in (".csv", ".JSON", ".parquet")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_normalize_types(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 2).cast("array<int>").alias("head"), F.to_date(F.lit("2024-02-29")).alias("day"),
        F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("vec_id") / 2).alias("half"), (F.col("label") > 2).alias("flag"))
    return normalize_types(e)


def q_write_summary_csv(spark, sf):
    path = scratch_path(spark, "summary")
    write_csv(summary.numerical_summary(table(spark, sf, "events"), ["value"], ["event_type"]), path)
    return read_csv(spark, path)


def q_unique_names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("Key"), F.col("p_size").alias("A b"), F.col("p_name").alias("a-b"),
                                        F.col("p_brand").alias("a_b_2"), F.col("p_type").alias("$"))
    return clean.clean_names(p)[0]


def q_cast_category(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    out = clean.cast_columns(p, ["p_size"], "category")[0]
    return summary.categorical_summary(out, "p_size")


def q_cast_int_nan(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double")).alias("size"),
                                        F.when(F.col("p_size") % 5 == 0, F.lit("nan")).otherwise(F.col("p_retailprice").cast("string")).alias("price"))
    out = clean.cast_columns(p, ["size"], "integer")[0]
    return clean.cast_columns(out, ["price"], "float")[0]


def q_drop_values_int(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    recipe = CleaningRecipe().with_rule(parse_drop_rule("p_size", " 05, --7, 10, 12 ,12, 13.0"))
    return recipe.apply(p)[0]


def q_impute_mode_tie(spark, sf):
    """Two sizes made equally frequent, as a number category: 2 before 10."""
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, 10).when(F.col("p_partkey") % 4 == 1, 2).when(
        F.col("p_partkey") % 4 == 2, F.lit(None)).otherwise(F.col("p_partkey") + 100).cast("int").alias("size"))
    cat = clean.cast_columns(p, ["size"], "category")[0]
    return fit.fit_impute(cat, "mean").transform(cat)


def q_ln_bool(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") > 0).alias("positive"), "p_retailprice")
    out, _ = CleaningRecipe(apply_log=True, log_cols=("positive", "p_retailprice")).apply(p)
    return _round_cols(out, {"p_retailprice": 9})


def q_onehot_keep_double(spark, sf):
    kind = F.col("o_custkey") % 5
    o = table(spark, sf, "orders").select("o_orderkey", F.when(kind == 0, F.lit(2e7)).when(kind == 1, F.lit(0.0005)).when(
        kind == 2, F.lit(float("nan"))).otherwise(kind.cast("double")).alias("level"))
    return make_one_hot_rule(o, "level").apply(o).drop("level")


def q_step_log(spark, sf):
    recipe = CleaningRecipe(remove_duplicates=True, missing_strategy="drop_rows", missing_threshold=20, handle_outliers=True,
                            outlier_action="remove", outlier_cols=("Total-Price ($)",), drop_rules=(DropRule("Status", ("P",)),))
    out, log = recipe.apply(dirty_orders(spark, sf))
    out.write.format("noop").mode("overwrite").save()
    return log.to_dataframe(spark).where("rows_removed is not null").select("step", "rows_removed")


def q_rule_toggle(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    recipe = (CleaningRecipe().with_rule(DropRule("o_orderstatus", ("P",))).with_rule(DropRule("o_orderstatus", ("F",)))
              .with_rule(DropRule("o_orderpriority", ("2-HIGH",))))
    return recipe.toggled(1, False).without_rule(0).apply(o)[0]


def q_prepare_file(spark, sf):
    """A file through load, cleaning and features in one go."""
    path = scratch_path(spark, "orders") + ".csv"
    write_csv(dirty_orders(spark, sf), path)
    recipe = CleaningRecipe(remove_duplicates=True, missing_strategy="mean_mode")
    rules = FeatureRules(logs=[make_log2_rule("total_price_", "price_log2")])
    done = prepare_file(spark, path, recipe, rules)
    return _round_cols(done.explore([RangeFilter("total_price_", 100000.0, 300000.0)]).drop("sparse"), {"total_price_": 6, "price_log2": 9})


# ------------------------------------------------------------- features

def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


def q_map_mean(spark, sf):
    o = _orders(spark, sf)
    return apply_map_rules(o, [make_map_rule(o, "o_totalprice", ">", "mean", "price_band", "high")])


def q_map_median(spark, sf):
    o = _orders(spark, sf)
    return apply_map_rules(o, [make_map_rule(o, "o_totalprice", "<=", "median", "price_band", "low")])


def q_map_chain(spark, sf):
    o = _orders(spark, sf)
    rules = [make_map_rule(o, "o_totalprice", ">", "custom", "tier", "mid", 100000),
             make_map_rule(o, "o_totalprice", ">", "custom", "tier", "top", 300000),
             make_map_rule(o, "o_totalprice", "<", "custom", "tier", "1", 20000)]
    return apply_map_rules(o, rules)


def q_map_sequence(spark, sf):
    """The second rule reads what the first wrote."""
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    rules = [make_map_rule(p, "p_size", ">", "custom", "p_size", "5", 40), make_map_rule(p, "p_size", "<", "custom", "flag", "low", 10)]
    return apply_map_rules(p, rules)


def q_bin_int(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return apply_bin(p, make_bin_rule(p, "p_size", "10, 20, 30, 40", "size_bin"))


def q_bin_float(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return apply_bin(c, make_bin_rule(c, "c_acctbal", [0, 2500, 5000, 7500], "balance_bin"))


def q_log2_new(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = apply_log2(c, make_log2_rule("c_acctbal", "acctbal_log2"))
    return _round_cols(out, {"acctbal_log2": 9})


# ------------------------------------------------------------- plot data

def q_hist(spark, sf):
    h = plotdata.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30)
    return _round_cols(h, {"bin_lo": 6, "bin_hi": 6})


def q_hist_discount(spark, sf):
    h = plotdata.histogram(table(spark, sf, "lineitem"), "l_discount", 30)
    return _round_cols(h, {"bin_lo": 6, "bin_hi": 6})


def q_hist_by(spark, sf):
    h = plotdata.histogram(table(spark, sf, "events"), "value", 20, group_by="event_type")
    return _round_cols(h, {"bin_lo": 6, "bin_hi": 6})


def q_hist_log2(spark, sf):
    h = plotdata.log2_histogram(table(spark, sf, "customer"), "c_acctbal", 20)
    return _round_cols(h, {"bin_lo": 6, "bin_hi": 6})


def q_density(spark, sf):
    d = plotdata.density(table(spark, sf, "part"), "p_retailprice", group_by="p_type")
    return _round_cols(d, {"x": 6, "density": 10})


def q_density_series(spark, sf):
    """A near-unique column by the Gauss transform: moments of cells meet the grid."""
    d = plotdata.density(table(spark, sf, "events"), "value", group_by="event_type", series=True)
    return _round_cols(d, {"x": 6, "density": 8})


def q_box(spark, sf):
    b = plotdata.box_stats(table(spark, sf, "events"), "value", "event_type")
    return _round_cols(b, {c: 6 for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


def q_box_outliers(spark, sf):
    return plotdata.box_outliers(table(spark, sf, "events"), "value", "event_type")


def q_bar(spark, sf):
    return plotdata.bar_counts(table(spark, sf, "events"), "event_type")


def q_line(spark, sf):
    o = table(spark, sf, "orders")
    ln = plotdata.line_series(o, "o_orderdate", "o_totalprice", "o_orderstatus")
    return _round_cols(ln, {"y_mean": 6})


def q_line_day(spark, sf):
    e = table(spark, sf, "events").select(F.date_trunc("DAY", "ts").alias("day"), "event_type", "value")
    ln = plotdata.line_series(e, "day", "value", "event_type")
    return _round_cols(ln, {"y_mean": 6})


def q_line_text_day(spark, sf):
    """A text column of dates becomes the x of a line."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"), "o_totalprice")
    ln = plotdata.line_series(o, "day", "o_totalprice")
    return _round_cols(ln, {"y_mean": 6})


def q_line_choices(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus", "o_totalprice")
    return spark.createDataFrame(list(enumerate(plotdata.line_x_choices(o), 1)), "place int, column string")


def q_box_points(spark, sf):
    return plotdata.box_points(dirty_orders(spark, sf), "Total-Price ($)", "Priority")


def q_datetime_detect(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority", "o_orderstatus")
    return plotdata.datetime_report(o)


def q_corr_matrix(spark, sf):
    c = corr.correlation_matrix(table(spark, sf, "lineitem"), LINE_NUMS)
    return _round_cols(c, {"corr": 9})


def _wide(spark, sf):
    """A column for each component of the embeddings."""
    return table(spark, sf, "embeddings").select(*[F.try_element_at("embedding", F.lit(i + 1)).cast("double").alias(f"d{i}") for i in range(64)])


def q_corr_wide(spark, sf):
    return _round_cols(corr.correlation_matrix(_wide(spark, sf), [f"d{i}" for i in range(64)]), {"corr": 9})


def q_regression_wide(spark, sf):
    return _round_cols(corr.pair_regression(_wide(spark, sf), [f"d{i}" for i in range(64)]), {"slope": 9, "intercept": 9})


def q_pair_regression(spark, sf):
    r = corr.pair_regression(table(spark, sf, "lineitem"), LINE_NUMS)
    return _round_cols(r, {"slope": 6, "intercept": 6})


def q_scatter_hist(spark, sf):
    h = corr.scatter_matrix_data(table(spark, sf, "lineitem"), LINE_NUMS[:3])["histograms"]
    return _round_cols(h, {"bin_lo": 6, "bin_hi": 6})


def q_scatter_matrix(spark, sf):
    m = corr.scatter_matrix_table(table(spark, sf, "lineitem"), LINE_NUMS[:3])
    return _round_cols(m, {"bin_lo": 6, "bin_hi": 6, "slope": 6, "intercept": 6, "corr": 9})


# ------------------------------------------------------------- other tables

def q_doc_length_summary(spark, sf):
    d = table(spark, sf, "documents").select(
        "lang", F.length("text").cast("long").alias("text_chars"), "n_chars")
    return summary.numerical_summary(d, ["text_chars", "n_chars"], ["lang"])


def q_doc_overview(spark, sf):
    d = table(spark, sf, "documents").select("text", "lang", "source")
    return summary.dataset_overview(d, clean.drop_duplicates(d))


def q_source_top_n(spark, sf):
    return summary.categorical_summary(table(spark, sf, "documents"), "source", top_n=5)


def q_top_urls(spark, sf):
    """Most frequent urls, by sketch and hashes."""
    return summary.categorical_summary(table(spark, sf, "pages"), "url", top_n=10, sketch=True)


def q_top_texts(spark, sf):
    """Most copied whole texts: only those that count are ever shuffled."""
    return summary.categorical_summary(table(spark, sf, "documents"), "text", top_n=10, sketch=True)


def q_conversation_roles(spark, sf):
    return summary.categorical_summary(table(spark, sf, "conversations"), "role")


def q_label_summary(spark, sf):
    return summary.numerical_summary(table(spark, sf, "labels"), ["quality", "toxic"])


# ------------------------------------------------------------- end to end

def prepared_orders(spark, sf):
    d = dirty_orders(spark, sf)
    recipe = CleaningRecipe(remove_duplicates=True, missing_strategy="median_mode",
                            handle_outliers=True, outlier_cols=("Total-Price ($)",),
                            drop_rules=(DropRule("Status", ("P",)),),
                            keep_after_dedup="persist")
    cleaned, log = recipe.apply(d)
    rules = FeatureRules(
        maps=[make_map_rule(cleaned, "total_price_", ">", "median", "price_flag", "high")],
        bins=[make_bin_rule(cleaned, "total_price_", [100000, 200000, 300000], "price_bin")],
        one_hots=[make_one_hot_rule(cleaned, "status")],
        logs=[make_log2_rule("total_price_", "price_log2")])
    feats, errors = rules.apply(cleaned)
    if errors:
        raise RuntimeError("; ".join(errors))
    return feats


def q_clean_engineer_summary(spark, sf):
    feats = prepared_orders(spark, sf)
    return summary.numerical_summary(feats, ["total_price_", "price_log2", "sparse"],
                                     ["price_bin", "price_flag"])


def q_clean_engineer_categories(spark, sf):
    return summary.categorical_summary(prepared_orders(spark, sf), "price_bin")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "num_summary": q_num_summary,
    "num_summary_grouped": q_num_summary_grouped,
    "num_summary_filtered": q_num_summary_filtered,
    "num_summary_levels": q_num_summary_levels,
    "filter_status": q_filter_status,
    "cat_summary": q_cat_summary,
    "cat_top_n": q_cat_top_n,
    "cat_summary_missing": q_cat_summary_missing,
    "missing_table": q_missing_table,
    "overview": q_overview,
    "filter_bounds": q_filter_bounds,
    "filter_choices": q_filter_choices,
    "column_facts": q_column_facts,
    "trim_names": q_trim_names,
    "dedup": q_dedup,
    "drop_rows_missing": q_drop_rows_missing,
    "drop_cols_missing": q_drop_cols_missing,
    "impute_mean": q_impute_mean,
    "impute_median": q_impute_median,
    "cast_int": q_cast_int,
    "cast_float": q_cast_float,
    "cast_text": q_cast_text,
    "scale_z": q_scale_z,
    "scale_minmax": q_scale_minmax,
    "onehot_replace": q_onehot_replace,
    "onehot_keep": q_onehot_keep,
    "ln_gate": q_ln_gate,
    "outlier_cap": q_outlier_cap,
    "outlier_remove": q_outlier_remove,
    "drop_values": q_drop_values,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_file": q_csv_file,
    "map_mean": q_map_mean,
    "map_median": q_map_median,
    "map_chain": q_map_chain,
    "bin_int": q_bin_int,
    "bin_float": q_bin_float,
    "log2_new": q_log2_new,
    "hist": q_hist,
    "hist_by": q_hist_by,
    "hist_log2": q_hist_log2,
    "density": q_density,
    "density_series": q_density_series,
    "box": q_box,
    "box_outliers": q_box_outliers,
    "bar": q_bar,
    "line_orders": q_line,
    "line_day": q_line_day,
    "datetime_detect": q_datetime_detect,
    "corr_matrix": q_corr_matrix,
    "pair_regression": q_pair_regression,
    "corr_wide": q_corr_wide,
    "regression_wide": q_regression_wide,
    "scatter_hist": q_scatter_hist,
    "doc_length_summary": q_doc_length_summary,
    "doc_overview": q_doc_overview,
    "source_top_n": q_source_top_n,
    "top_urls": q_top_urls,
    "top_texts": q_top_texts,
    "conversation_roles": q_conversation_roles,
    "label_summary": q_label_summary,
    "num_summary_missing_level": q_num_summary_missing_level,
    "stat_select": q_stat_select,
    "cat_stat_select": q_cat_stat_select,
    "distinct_missing": q_distinct_missing,
    "preview": q_preview,
    "preview_head": q_preview_head,
    "row_numbers": q_row_numbers,
    "onehot_first_seen": q_onehot_first_seen,
    "datetime_first_cells": q_datetime_first_cells,
    "json_roundtrip": q_json_roundtrip,
    "load_dispatch": q_load_dispatch,
    "normalize_types": q_normalize_types,
    "write_summary_csv": q_write_summary_csv,
    "unique_names": q_unique_names,
    "cast_category": q_cast_category,
    "cast_int_nan": q_cast_int_nan,
    "drop_values_int": q_drop_values_int,
    "impute_mode_tie": q_impute_mode_tie,
    "ln_bool": q_ln_bool,
    "onehot_keep_double": q_onehot_keep_double,
    "step_log": q_step_log,
    "rule_toggle": q_rule_toggle,
    "prepare_file": q_prepare_file,
    "map_sequence": q_map_sequence,
    "hist_discount": q_hist_discount,
    "line_text_day": q_line_text_day,
    "line_choices": q_line_choices,
    "box_points": q_box_points,
    "scatter_matrix": q_scatter_matrix,
    "clean_engineer_summary": q_clean_engineer_summary,
    "clean_engineer_categories": q_clean_engineer_categories,
}
