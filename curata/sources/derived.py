"""The given tables, and tables derived from them with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with derived dirt: untidy names, padded text, missing cells,
    a sparse column, text codes, one bad code, and every 20th order twice."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    dirty = o.select(
        k.alias("Order Key"),
        F.when(k % 5 == 0, F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit("  ")))
        .otherwise(F.col("o_orderstatus")).alias("Status"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice"))
        .alias("Total-Price ($)"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))
        .alias("Priority"),
        F.when(k % 10 == 0, F.col("o_custkey")).alias("Sparse"),
        F.col("o_custkey").cast("string").alias("Code Text"),
        F.when(k % 1000 == 0, F.lit("x")).otherwise(F.col("o_custkey").cast("string"))
        .alias("Bad Code"),
    )
    return dirty.unionByName(dirty.where(F.col("`Order Key`") % 20 == 0))
