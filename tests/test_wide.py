"""Wide panels: packed factors give the same answers, and plans do not grow with the factors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.functions import wide
from paneltide.functions.moments import nan_to_null
from paneltide.operators import preprocess as B
from paneltide.session import stored

CONFIG = {"filter": {"drop_st": True},
          "neutralize": {"enabled": True, "neutral_cols": ["log_mktcap", "beta"]}}


def wide_panel(spark, n_factors, n_days=3, n_stocks=25, seed=5):
    rng = np.random.default_rng(seed)
    rows = n_days * n_stocks
    values = rng.normal(size=(rows, n_factors))
    values[rng.random(values.shape) < .05] = np.nan
    values[0, 0] = np.inf
    pdf = pd.DataFrame(values, columns=[f"factor_{i:04d}" for i in range(n_factors)])
    names = list(pdf.columns)
    pdf.insert(0, "date", np.repeat(pd.bdate_range("2020-01-01", periods=n_days).date, n_stocks))
    pdf.insert(1, "stock_id", [f"s{i:02d}" for i in range(n_stocks)] * n_days)
    pdf.insert(2, "industry", rng.choice(["tech", "bank", None], rows))
    pdf.insert(3, "log_mktcap", rng.normal(20, 1, rows))
    pdf.insert(4, "beta", np.where(rng.random(rows) < .1, np.nan, rng.normal(1, .2, rows)))
    pdf.insert(5, "is_st", (rng.random(rows) < .1).astype(int))
    return stored(nan_to_null(spark.createDataFrame(pdf)), "wide"), names


def table(df, names):
    return df.select("date", "stock_id", *names).toPandas().set_index(["date", "stock_id"]).sort_index().astype(float)


@pytest.mark.parametrize("config", [
    CONFIG,
    {"fill_missing": {"method": "industry_median"}, "winsorize": {"lower": .1, "upper": .8}, "standardize_by_industry": True},
    {"fill_missing": {"method": "zero"}, "standardize": False, "neutralize": {"enabled": True, "use_industry": False}}])
def test_packed_factors_give_the_answers_of_columns(spark, monkeypatch, config):
    df, names = wide_panel(spark, 6)
    plain = table(B.preprocess(df, names, config, float32=False), names)
    monkeypatch.setattr(wide, "WIDE", 2)
    monkeypatch.setattr(B, "WIDE", 2)
    packed = B.preprocess(df, names, config, float32=False)
    assert packed.columns == df.columns
    pd.testing.assert_frame_equal(table(packed, names), plain, atol=1e-9)


def test_dates_in_slices_where_coefficients_are_too_large_to_send(spark):
    df, names = wide_panel(spark, 30, n_days=6)
    df = df.unionByName(df.limit(3).withColumn("date", F.lit(None).cast("date")))
    wanted = table(B.preprocess(df, names, CONFIG, float32=False), names)
    spark.conf.set("paneltide.broadcast.maxBytes", "6000")
    try:
        out = B.preprocess(df, names, CONFIG, float32=False)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = table(out, names)
    finally:
        spark.conf.unset("paneltide.broadcast.maxBytes")
    pd.testing.assert_frame_equal(got, wanted, atol=1e-9)
    assert plan.count("BroadcastHashJoin") > 8 and "Exchange hashpartitioning" not in plan


def test_joins_do_not_grow_with_a_thousand_factors(spark):
    joins = {}
    for n in (30, 1000):
        df, names = wide_panel(spark, n, n_days=1)
        out = B.preprocess(df, names, CONFIG, float32=False)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        joins[n] = plan.count("BroadcastHashJoin")
        assert out.count()
    assert joins[30] == joins[1000] <= 5


def test_wide_panel_is_dealt_by_cells_and_steps_are_stored(panel, monkeypatch):
    """All passes over a wide panel are shared out, and no step redoes the one before it."""
    names = [f"factor_{i:03d}" for i in range(1, 31)]
    df = panel.select("date", "stock_id", "industry", "beta", *(
        (panel.factor_001 * (i + 1)).alias(c) for i, c in enumerate(names))).coalesce(1)
    kept, store = [], B.stored

    def seen(table, name):
        kept.append((name, table.rdd.getNumPartitions()))
        return store(table, name)

    monkeypatch.setattr(B, "stored", seen)
    monkeypatch.setattr(wide, "TASK_CELLS", 9_000)
    out = B.preprocess(df, names, {"neutralize": {"enabled": True, "neutral_cols": ["beta"]}}, float32=False)
    assert out.count() == df.count() == 1800
    assert kept[1] == ("panel", 6) and [n for n, _ in kept] == ["panel", "panel", "clipped", "standardized"]


def test_dates_that_fit_a_task_are_worked_on_whole(spark, monkeypatch):
    """No pass over single cells, and the answers of those passes, also for odd columns, rows and dates."""
    df, names = wide_panel(spark, 30, n_days=4)
    odd = {"factor_0001": F.lit(0.1), "factor_0002": F.lit(None).cast("double"), "log_mktcap": F.when(
        F.col("stock_id") == "s03", F.lit(float("inf"))).otherwise(F.col("log_mktcap")), "factor_0003": F.when(
        F.col("stock_id") == "s05", F.col("factor_0003")), "factor_0004": F.when(F.col("stock_id") < "s05", F.lit(float("inf"))).otherwise(1.5)}
    last = df.agg(F.max("date")).first()[0]
    df = df.withColumns(odd).filter((F.col("date") < F.lit(last)) | (F.col("stock_id") < "s04"))
    df = stored(df.unionByName(df.limit(3).withColumn("date", F.lit(None).cast("date"))), "odd")
    for config in (CONFIG, {**CONFIG, "winsorize": {"lower": .1, "upper": .8}, "fill_missing": {"method": "zero"}}, {**CONFIG, "standardize": False}):
        spark.conf.set("paneltide.group.maxRows", "0")
        try:
            wanted = B.preprocess(df, names, config, float32=False).sort("date", "stock_id").collect()
        finally:
            spark.conf.unset("paneltide.group.maxRows")
        with monkeypatch.context() as patch:
            for step in ("quantile_arrays", "per_cell", "standardize_cells", "residual_cells"):
                if config.get("fill_missing") is None or step != "per_cell":
                    patch.setattr(B, step, None)
            got = B.preprocess(df, names, config, float32=False).sort("date", "stock_id").collect()
        assert len(got) == len(wanted) == df.filter("is_st = 0").count()
        for a, b in zip(got, wanted):
            assert a[:6] == b[:6]
            for c in names:  # None apart from NaN
                assert (a[c] is None) == (b[c] is None), (c, a[c], b[c])
                assert a[c] is None or np.isclose(a[c], b[c], rtol=1e-9, atol=1e-9, equal_nan=True), (c, a[c], b[c])
