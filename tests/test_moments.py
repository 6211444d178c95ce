"""Standardizing, correlation and residuals against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.functions.lookup import attach
from paneltide.functions.moments import nan_to_null, ols_residual, pearson, standardize


def lstsq_residual(pdf, y, xs, group=None):
    out = pd.Series(np.nan, index=pdf.index)
    for _, g in pdf.groupby("date"):
        columns = [np.ones(len(g))] + [g[x].fillna(g[x].median()).fillna(0) for x in xs]
        if group:
            names = g[group].fillna("UNKNOWN")
            columns += [(names == k).astype(float) for k in sorted(names.unique())[1:]]
        x, ok = np.column_stack(columns), g[y].notna().to_numpy()
        if ok.sum() > x.shape[1]:
            b, *_ = np.linalg.lstsq(x[ok], g[y][ok], rcond=None)
            out[g.index[ok]] = g[y][ok] - x[ok] @ b
    return out


@pytest.fixture(scope="module")
def messy(panel_pd):
    pdf = panel_pd.copy()
    rng = np.random.default_rng(1)
    pdf.loc[rng.random(len(pdf)) < 0.1, "volatility"] = np.nan
    pdf.loc[rng.random(len(pdf)) < 0.1, "industry"] = None
    pdf["twice_beta"] = 2 * pdf.beta + 3
    last = pdf.date.max()
    return pdf[(pdf.date < last) | (pdf.stock_id < "s005")].reset_index(drop=True)


@pytest.mark.parametrize("xs", [["log_mktcap", "beta", "turnover", "volatility"],
                                ["beta", "twice_beta", "volatility"], []])
@pytest.mark.parametrize("group", ["industry", None])
def test_residual_matches_lstsq(spark, messy, xs, group):
    df = nan_to_null(spark.createDataFrame(messy))
    out = ols_residual(df, ["date"], ["factor_002"], xs, group, {"factor_002": "res"})
    got = out.toPandas().set_index(["date", "stock_id"]).res
    want = messy.assign(want=lstsq_residual(messy, "factor_002", xs, group)).set_index(
        ["date", "stock_id"]).want
    got = got.reindex(want.index)
    assert got.isna().equals(want.isna())
    np.testing.assert_allclose(got.dropna(), want.dropna(), atol=1e-9)


def test_residual_without_enough_rows_is_null(spark, messy):
    df = nan_to_null(spark.createDataFrame(messy[messy.date == messy.date.max()]))
    out = ols_residual(df, ["date"], ["factor_001"], ["beta", "turnover", "volatility"], "industry")
    assert out.filter("factor_001 IS NOT NULL").count() == 0


def test_flat_groups(spark):
    df = spark.createDataFrame([("a", "1", 2.0), ("a", "2", 2.0), ("a", "3", None),
                                ("b", "1", 5.0), ("c", "1", 1.0), ("c", "2", 3.0)],
                               "date string, stock_id string, v double")
    zero = {(r.date, r.stock_id): r.v for r in standardize(df, ["date"], ["v"]).collect()}
    assert zero["a", "1"] == zero["a", "3"] == zero["b", "1"] == 0
    assert zero["c", "2"] == pytest.approx(2 ** -0.5)
    null = standardize(df, ["date"], ["v"], zero_when_flat=False).filter("v IS NULL").count()
    assert null == 4


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0),
                                ("c", 1.0, 2.0), ("c", 2.0, 4.0), ("c", None, 9.0)],
                               "date string, x double, y double")
    out = {r.date: r.ic for r in df.groupBy("date").agg(pearson("x", "y").alias("ic")).collect()}
    assert out["a"] is None and out["b"] is None and out["c"] == pytest.approx(1)


def test_attach_broadcasts_only_what_fits(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 5)
    table = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    def plan(d):
        return d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(attach(df, table, ["k"]))
    spark.conf.set("paneltide.broadcast.maxBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beyond = attach(df, table, ["k"])
        assert "SortMergeJoin" in plan(beyond)
        assert beyond.filter("v <> k * 2").count() == 0
    finally:
        spark.conf.unset("paneltide.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_standardize_of_a_null_group(spark, either_path):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", 9.0)], "g string, v double")
    got = sorted((r.g or "", round(r.v, 6)) for r in standardize(df, ["g"], ["v"]).collect())
    assert got == [("", -0.707107), ("", 0.707107), ("a", -0.707107), ("a", 0.707107)]


def test_residual_leaves_out_only_rows_that_are_not_finite(spark, either_path):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"date": 1, "stock_id": range(30), "x": rng.normal(size=30), "y": rng.normal(size=30)})
    rows = [(1, int(i), float(x), float(y)) for i, x, y in zip(pdf.stock_id, pdf.x, pdf.y)]
    broken = [(1, 100, 0.5, float("nan")), (1, 101, 0.5, float("inf")), (1, 102, float("-inf"), 0.3), (1, 103, 0.1, None)]
    df = spark.createDataFrame(rows + broken, "date int, stock_id int, x double, y double")
    got = {r.stock_id: r.e for r in ols_residual(df, ["date"], ["y"], ["x"], names={"y": "e"}).collect()}
    wanted = lstsq_residual(pdf, "y", ["x"])
    assert np.allclose([got[i] for i in range(30)], wanted, atol=1e-9)
    assert all(got[i] is None for i in (100, 101, 102, 103))
