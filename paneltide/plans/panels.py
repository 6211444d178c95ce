"""Panels derived from the given tables: inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.functions.lookup import attach
from paneltide.functions.order import shift_rows
from paneltide.session import settle

STYLES = ["log_mktcap", "beta", "turnover", "volatility"]
FACTORS = ["factor_001", "factor_002", "factor_003", "factor_004"]
MODELS = {  # model name -> (family, source column)
    "gbt_reg_excess_h1_v01": ("lightgbm", "factor_001"),
    "gbt_rank_excess_h1_v01": ("lightgbm", "factor_003"),
    "rf_reg_excess_h1_v01": ("xgboost", "factor_004"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(column: str, f=F.sum):
    return f(F.rint(F.col(column) * 100).cast("bigint")).cast("double")


def _span(column: str):
    """Largest less smallest value, as a quotient of whole numbers."""
    return (_cents(column, F.max) - _cents(column, F.min)) / 100


def supplier_months(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (month of shipping, supplier).

    Line items are aggregated before the supplier dimension is joined, and only
    exact integer sums are used, so the digits do not depend on the order.
    """
    lines = (table(spark, folder, "lineitem")
             .withColumn("date", F.trunc("l_shipdate", "month")))
    quantity, n = F.sum("l_quantity"), F.count(F.lit(1))
    returned = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    many = F.col("n_lines") > 1
    months = (lines.groupBy("date", "l_suppkey")
              .agg(n.alias("n_lines"), quantity.alias("volume"),
                   _cents("l_extendedprice").alias("_price"), _cents("l_tax").alias("_tax"),
                   _cents("l_discount").alias("_disc"), returned.alias("_returned"),
                   _span("l_extendedprice").alias("_price_span"),
                   _span("l_discount").alias("_disc_span")))
    places = (table(spark, folder, "supplier")
              .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
              .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("industry")))
    return months.join(places, "l_suppkey").select(
        "date", F.col("l_suppkey").cast("string").alias("stock_id"), "industry",
        (F.col("_price") / F.col("volume")).alias("close"),
        "volume", F.col("volume").alias("turnover"), "n_lines",
        F.round(F.log(F.col("_price") / 100), 4).alias("log_mktcap"),
        (F.col("_tax") / F.col("n_lines")).alias("beta"),
        F.when(many, F.col("_price_span")).alias("volatility"),
        F.col("_price").alias("adv"),
        (F.col("_disc") / F.col("n_lines")).alias("factor_001"),
        F.when(many, F.col("_disc_span")).alias("factor_002"),
        (F.col("volume") / F.col("n_lines")).alias("factor_003"),
        (F.col("_returned").cast("double") / F.col("n_lines")).alias("factor_004"),
        (F.col("n_lines") == 1).cast("int").alias("is_st"),
        (F.col("_returned") == F.col("n_lines")).cast("int").alias("is_suspended"))


def stored_months(spark: SparkSession, folder: str) -> DataFrame:
    """The supplier panel, derived once and kept for the several scans of a query."""
    return settle(supplier_months(spark, folder))


def with_returns(panel: DataFrame) -> DataFrame:
    """Add ``return`` against the entity's previous row."""
    before = shift_rows(panel, ["stock_id"], "date", "close", {"_before": -1})
    return before.withColumn("return", F.col("close") / F.col("_before") - 1).drop("_before")


def with_benchmark(panel: DataFrame) -> DataFrame:
    """Add the share of the date's volume."""
    totals = panel.groupBy("date").agg(F.sum("volume").alias("_total"))
    return (attach(panel, totals, ["date"])
            .withColumn("benchmark_weight", F.col("volume") / F.col("_total")).drop("_total"))


def user_days(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (day, user) of the event stream; many users miss days."""
    return (table(spark, folder, "events")
            .groupBy(F.to_date("ts").alias("date"),
                     F.col("user_id").cast("string").alias("stock_id"))
            .agg(F.count(F.lit(1)).alias("n_events"), _cents("value").alias("close"),
                 F.max_by("event_type", F.struct("ts", "event_id")).alias("industry")))


def raw_signals(panel: DataFrame) -> DataFrame:
    """Three models' raw scores in long form, with their constant metadata."""
    rows = F.array(*(F.struct(F.lit(family).alias("model_family"), F.lit(name).alias("model_name"),
                              F.col(source).alias("raw_score"))
                     for name, (family, source) in MODELS.items()))
    return (panel.select("date", "stock_id", F.explode(rows).alias("m"))
            .select("date", "stock_id", "m.*", F.lit("v01").alias("model_version"),
                    F.lit("excess_return").alias("label_type"), F.lit(1).alias("horizon"),
                    F.lit("regression").alias("objective_type")))
