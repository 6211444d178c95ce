"""Targets look ahead exactly as far as they say; windows never overlap."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.operators import labels as C
from paneltide.operators import splits as D

KEY = ["date", "stock_id"]


@pytest.fixture(scope="module")
def labels(panel):
    return C.build_labels(panel, {"horizons": [1, 5]}).toPandas().set_index(KEY).sort_index()


@pytest.fixture(scope="module")
def wide(panel_pd):
    return panel_pd.pivot(index="date", columns="stock_id", values="close")


def test_raw_return_alignment_and_tail(panel, panel_pd, wide):
    out = C.forward_return(panel, 5).toPandas().pivot(index="date", columns="stock_id",
                                                      values="y_raw_5")
    pd.testing.assert_frame_equal(out, wide.shift(-5) / wide - 1, check_names=False)
    assert out.tail(5).isna().all().all() and out.iloc[:-5].notna().all().all()


def test_benchmark_compounds_and_has_a_null_tail(panel, panel_pd):
    out = C.benchmark_forward_return(panel, 3).toPandas().set_index("date").bench_fwd_3
    daily = panel_pd.groupby("date")["return"].mean().fillna(0)
    want = (1 + daily).rolling(3).apply(np.prod).shift(-3) - 1
    np.testing.assert_allclose(out.sort_index(), want.sort_index(), rtol=1e-10)


def test_label_ranges(labels):
    assert labels.y_rank_5.min() == 0 and labels.y_rank_5.max() == 1
    assert set(labels.y_group_5.dropna()) == {0, 1, 2, 3, 4}
    share = labels.y_class_5.dropna().value_counts(normalize=True)
    assert abs(share[1] - 0.2) < 0.05 and abs(share[0] - 0.2) < 0.05
    assert abs(labels.y_excess_1.groupby("date").mean()).max() < 0.05


def test_residual_label_is_orthogonal(panel):
    out = C.residual_return(C.forward_return(panel, 1), 1, ["beta"]).toPandas().dropna(
        subset=["y_residual_1"])
    worst = out.groupby("date").apply(lambda d: abs(np.corrcoef(d.y_residual_1, d.beta)[0, 1]))
    assert worst.max() < 1e-6


def test_dropping_the_middle(panel):
    out = C.rank_labels(C.forward_return(panel, 1), 1, keep_middle=False, kinds=("class",))
    values = {r[0] for r in out.select("y_class_1").distinct().collect()}
    assert values == {0, 1, None}


def test_missing_inputs_and_unknown_types(panel):
    with pytest.raises(ValueError):
        C.excess_return(panel, 5)
    with pytest.raises(ValueError):
        C.build_labels(panel.drop("close"), {})
    with pytest.raises(ValueError):
        C.label_column("other", 1)
    assert C.label_column("group_label", 5) == "y_group_5"


def test_label_quality(panel):
    df = C.forward_return(panel, 5)
    row = C.label_quality(df, ["y_raw_5"]).first()
    assert row.coverage == pytest.approx(55 / 60) and 0 <= row.extreme_ratio < 0.05


def test_query_groups_and_relevance(panel):
    sizes = C.group_sizes(panel).orderBy("date").collect()
    assert [r.group_id for r in sizes] == list(range(60)) and {r.n_rows for r in sizes} == {30}
    ids = C.with_group_ids(panel).select("date", "group_id").distinct()
    assert ids.count() == 60
    grouped = C.rank_labels(C.forward_return(panel, 1), 1, kinds=("group",))
    with pytest.raises(ValueError):
        C.relevance(grouped, "y_group_1")
    C.relevance(C.drop_unlabelled(grouped, "y_group_1"), "y_group_1")


def test_labels_do_not_depend_on_earlier_rows(panel, labels):
    """Labels of a date use later prices only."""
    cut = sorted({k[0] for k in labels.index})[20]
    late = C.build_labels(panel.filter(F.col("date") >= F.lit(cut)), {"horizons": [1]})
    late = late.toPandas().set_index(KEY).sort_index()
    both = late.join(labels, rsuffix="_all")
    np.testing.assert_allclose(both.y_raw_1, both.y_raw_1_all)
    np.testing.assert_allclose(both.y_residual_1, both.y_residual_1_all, atol=1e-10)


def add_months(day, months):
    month = day.year * 12 + day.month - 1 + months
    return dt.date(month // 12, month % 12 + 1, min(day.day, 28) if day.day > 1 else 1)


@pytest.mark.parametrize("start", ["2010-01-01", "2010-01-31", "2010-03-15"])
def test_rolling_windows(spark, start):
    rows = D.rolling_windows(spark, start, "2014-12-31", 2, 1, 3, 3).orderBy("window_id").collect()
    assert len({r.window_id for r in rows}) == len(rows)
    first = dt.date.fromisoformat(start)
    for i, r in enumerate(rows):
        first = add_months(first, 3) if i else first
        assert r.train_start == first and r.valid_start == add_months(first, 24)
        assert r.test_start == add_months(r.valid_start, 12)
        assert r.train_end < r.valid_start <= r.valid_end < r.test_start <= r.test_end
        assert r.window_id == f"w{i:03d}_{r.test_start:%Y%m%d}"
    assert rows[-1].test_end <= dt.date(2014, 12, 31)
    assert D.test_overlap(D.rolling_windows(spark, start, "2014-12-31", 2, 1, 3, 3)).isEmpty()
    assert not D.test_overlap(D.rolling_windows(spark, start, "2014-12-31", 2, 1, 6, 3)).isEmpty()


def test_expanding_windows_keep_their_start(spark):
    rows = D.expanding_windows(spark, "2010-01-01", "2015-06-30").orderBy("window_id").collect()
    assert {r.train_start for r in rows} == {dt.date(2010, 1, 1)}
    ends = [r.train_end for r in rows]
    assert ends == sorted(ends) and ends[0] == dt.date(2012, 12, 31)
    with pytest.raises(ValueError):
        D.expanding_windows(spark, "2010-01-01", "2011-01-01")


def test_embargo_cuts_trading_days(spark):
    days = pd.bdate_range("2010-01-01", "2013-12-31").date
    feats = spark.createDataFrame([(d, "a", 1.0) for d in days], "date date, stock_id string, f double")
    labs = spark.createDataFrame([(d, "a", 2.0) for d in days], "date date, stock_id string, y double")
    windows = D.rolling_windows(spark, "2010-01-01", "2013-12-31", 2, 1, 3, 3)
    rows = D.windowed_rows(windows, feats, labs, 5)
    audit = D.split_audit(rows).orderBy("window_id").collect()
    assert all(r.leaks == 0 for r in audit)
    bounds = {r.window_id: r for r in windows.collect()}
    for r in audit:
        w = bounds[r.window_id]
        assert sum(r.train_max < d <= w.train_end for d in days) == 5
        assert sum(r.valid_max < d <= w.valid_end for d in days) == 5
    with pytest.raises(ValueError):
        D.window_rows(windows, audit[0].window_id, feats.filter("date < '2012-01-01'"), labs, 5)


def test_indexed_rows_are_not_repeated(spark):
    """Counts by window from dates equal those of repeated rows; sizes of the windows agree."""
    days = spark.sql("SELECT explode(sequence(date'2010-01-01', date'2014-12-31', interval 1 month)) AS date")
    feats = days.selectExpr("date", "explode(sequence(1, 1 + month(date) % 3)) AS n").selectExpr(
        "date", "CAST(n AS STRING) AS stock_id", "1.0D AS factor_001")
    labs = feats.select("date", "stock_id", F.lit(0.5).alias("y"))
    windows = D.rolling_windows(spark, days, None, 2, 1, 3, 3)
    rows = D.indexed_rows(windows, feats, labs, 1)
    assert rows.count() == rows.select("date", "stock_id").distinct().count()
    repeated = D.windowed_rows(windows, feats, labs, 1)
    want = {(r.window_id, r.split): r["count"] for r in repeated.groupBy("window_id", "split").count().collect()}
    got = {(r.window_id, r.split): r.n for r in D.rows_by_window(rows).groupBy("window_id", "split").agg(
        F.sum("n_rows").alias("n")).collect()}
    assert got == want and len(got) > 9
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(D.split_audit(rows)) == key(D.split_audit(repeated))
    sizes = {r.window_id: r for r in D.window_sizes(windows, rows, D.calendar(labs), 1).collect()}
    assert all(sizes[w][f"{s}_rows"] == n for (w, s), n in want.items()) and all(r.train_days == 23 for r in sizes.values())
    with pytest.raises(ValueError):
        D.rolling_windows(spark, days.where("false"), None)


def test_all_horizons_are_ranked_in_one_pass(panel):
    plan = C.build_labels(panel, {})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
