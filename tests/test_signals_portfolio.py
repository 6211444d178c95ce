"""Invariants of scores, evaluation, ensembles and portfolios."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.operators import ensemble as H
from paneltide.operators import evaluation as G
from paneltide.operators import labels as C
from paneltide.operators import portfolio as I
from paneltide.operators import signals as S
from paneltide.session import settle

KEY = ["date", "stock_id"]
STYLES = ["log_mktcap", "beta", "turnover", "volatility"]


@pytest.fixture(scope="module")
def raw(panel):
    def one(name, family, column):
        return panel.select(*KEY, F.lit(family).alias("model_family"),
                            F.lit(name).alias("model_name"), F.lit("v01").alias("model_version"),
                            F.lit("excess_return").alias("label_type"), F.lit(1).alias("horizon"),
                            F.lit("regression").alias("objective_type"),
                            F.col(column).alias("raw_score"))
    return settle(one("good", "gbt", "factor_001").unionByName(one("noise", "forest", "beta")))


@pytest.fixture(scope="module")
def exposures(panel):
    return panel.select(*KEY, "industry", *STYLES)


@pytest.fixture(scope="module")
def processed(raw, exposures):
    return settle(S.process_signals(raw, exposures, {}))


@pytest.fixture(scope="module")
def returns(panel):
    return settle(C.forward_returns(panel.select(*KEY, "industry", "close"), [1, 5]).drop("close"))


def test_processed_fields_and_moments(processed):
    assert processed.columns == S.PROCESSED_FIELDS
    pdf = processed.toPandas()
    for score in ("zscore_score", "neutral_score"):
        stats = pdf.groupby(["model_name", "date"])[score].agg(["mean", "std"])
        assert stats["mean"].abs().max() < 1e-9 and (stats["std"] - 1).abs().max() < 1e-9
    assert pdf.rank_score.between(0, 1).all()


def test_neutral_scores_are_orthogonal(processed, exposures):
    pdf = processed.join(exposures, KEY).toPandas()
    by_industry = pdf.groupby(["model_name", "date", "industry"]).neutral_score.mean()
    assert by_industry.abs().max() < 1e-9
    corr = pdf.groupby(["model_name", "date"]).apply(
        lambda d: abs(np.corrcoef(d.neutral_score, d.log_mktcap)[0, 1]))
    assert corr.max() < 1e-9


def test_without_exposures_neutral_is_zscore(raw):
    out = S.process_signals(raw, None, {"winsorize": {"enabled": False}})
    assert out.filter("neutral_score <> zscore_score").isEmpty()


def test_perfect_signal(returns):
    df = returns.withColumn("signal", F.col("future_return_1d") * 3 + 1)
    ic = G.ic_summary(G.daily_ic(df, "signal", "future_return_1d")).first()
    ranks = G.ic_summary(G.daily_rank_ic(df, "signal", "future_return_1d"), "rank_ic").first()
    assert ic.ic_mean == pytest.approx(1) and ranks.ic_mean == pytest.approx(1)
    assert ic.n_days == 59 and ic.ic_positive_ratio == 1
    means = G.bucket_returns(df, "signal", "future_return_1d").toPandas().pivot(
        index="date", columns="bucket", values="group_return")
    assert (means.diff(axis=1).iloc[:, 1:] > 0).all().all()


def test_rank_ic_matches_pandas_with_ties(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"date": dt.date(2020, 1, 2), "stock_id": [str(i) for i in range(200)],
                        "s": rng.integers(0, 5, 200).astype(float), "r": rng.normal(size=200)})
    pdf.loc[:20, "r"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("r", F.nanvl("r", F.lit(None)))
    want = pdf.dropna()[["s", "r"]].rank().corr().iloc[0, 1]
    assert G.daily_rank_ic(df, "s", "r").first().rank_ic == pytest.approx(want)


def test_drawdown_leaves_out_the_starting_value(spark):
    rows = [(dt.date(2020, 1, d), r) for d, r in ((1, -0.5), (2, 0.1), (3, None), (4, -0.2))]
    out = G.drawdown(spark.createDataFrame(rows, "date date, r double"), "r").first()
    assert out.max_drawdown == pytest.approx(0.2)


def test_report_covers_models_and_scores(processed, returns, exposures):
    out = G.evaluate_signals(processed, returns, exposures, 5, 0.2)
    summary = out["model_summary"].toPandas().set_index(["model_name", "score_col"])
    assert len(summary) == 8 and summary.index.is_unique
    one = processed.filter("model_name = 'good'").join(returns, KEY)
    ic = G.ic_summary(G.daily_ic(one, "zscore_score", "future_return_1d")).first()
    assert summary.loc[("good", "zscore_score"), "ic_mean"] == pytest.approx(ic.ic_mean)
    moved = G.top_turnover(one, "zscore_score", 0.2).agg(F.avg("turnover")).first()[0]
    assert summary.loc[("good", "zscore_score"), "top_turnover_mean"] == pytest.approx(moved)
    compared = G.compare_models(out["model_summary"]).toPandas()
    assert set(compared.dimension) == set(G.COMPARED) and compared.level.notna().all()
    with pytest.raises(ValueError):
        G.evaluate_signals(processed, returns.drop("future_return_1d"))


def test_rows_of_signals_and_returns_are_not_broadcast(processed, returns, exposures, monkeypatch):
    """Both sides grow with the panel; a broadcast one would stand whole in the memory of every task."""
    plans = {}

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    kept = G.stored
    monkeypatch.setattr(G, "stored", spy)
    out = G.evaluate_signals(processed, returns, exposures, 5, 0.2)
    assert "BroadcastHashJoin" not in plans["long"] and plans["long"].count("SortMergeJoin") == 2
    assert out["ic_timeseries"].count() == out["long_short_return"].count() > 0


def test_weights_sum_to_one_and_use_the_past(processed, returns):
    _, weights = H.icir_weighted(processed, returns, 1, 10, 5, use_rank=True)
    pdf = weights.toPandas()
    assert np.allclose(pdf.groupby("date").weight.sum(), 1)
    known = pdf.dropna(subset=["info_as_of_date"])
    assert (known.info_as_of_date < known.date).all() and len(known) < len(pdf)


def test_later_returns_do_not_change_weights(processed, returns):
    days = [r.date for r in returns.select("date").distinct().orderBy("date").collect()]
    cut = days[30]
    changed = returns.withColumn("future_return_1d", F.when(
        F.col("date") >= F.lit(cut), -3 * F.col("future_return_1d") + 1).otherwise(
        F.col("future_return_1d")))
    first, second = (H.icir_weighted(processed, r, 1, 10, 5)[1].toPandas()
                     .set_index(["date", "model_name"]).weight.sort_index()
                     for r in (returns, changed))
    until = first.index.get_level_values(0) <= days[31]
    assert np.allclose(first[until], second[until])


def test_stacking_matches_a_loop(processed, returns):
    h, lookback, refit, alpha = 1, 12, 4, 1.0
    got = H.stacking(processed, returns, h, lookback, refit, alpha).toPandas().set_index(
        KEY).ensemble_score
    wide = processed.toPandas().pivot(index=KEY, columns="model_name", values="neutral_score")
    wide = wide.join(returns.toPandas().set_index(KEY).future_return_1d).sort_index()
    models, days, coef, want = ["good", "noise"], sorted(set(wide.index.get_level_values(0))), None, []
    for i, d in enumerate(days):
        end = i - h - 1
        if (coef is None or i % refit == 0) and end > 0:
            past = wide[wide.index.get_level_values(0).isin(days[max(0, end - lookback):end])].dropna()
            if len(past) > 10 * len(models):
                x, y = past[models].to_numpy(), past.future_return_1d.to_numpy()
                coef = np.linalg.solve(x.T @ x + alpha * np.eye(2), x.T @ y)
        rows = wide.loc[d][models]
        want.append(rows.mean(axis=1) if coef is None else rows.fillna(0) @ coef)
    np.testing.assert_allclose(got.sort_index().to_numpy(), pd.concat(want).to_numpy(), atol=1e-12)


def test_stacking_of_fifty_models(spark):
    rng, k, n, days = np.random.default_rng(1), 50, 60, 16
    dates = [dt.date(2020, 1, 1) + dt.timedelta(d) for d in range(days)]
    x = rng.normal(size=(days, n, k))
    y = x @ rng.normal(size=k) / k + rng.normal(size=(days, n))
    pdf = pd.DataFrame([(d, str(s), f"m{m:02d}", float(x[i, s, m])) for i, d in enumerate(dates)
                        for s in range(n) for m in range(k)], columns=[*KEY, "model_name", "neutral_score"])
    returns = pd.DataFrame([(d, str(s), float(y[i, s])) for i, d in enumerate(dates) for s in range(n)],
                           columns=[*KEY, "future_return_1d"])
    got = H.stacking(spark.createDataFrame(pdf), spark.createDataFrame(returns), 1, 12, 2, 1.0).toPandas()
    last = got[got.date == dates[-1]].set_index("stock_id").ensemble_score
    i = 14  # the last date on which a fit is due; its window ends horizon + 2 dates before
    a, b = x[max(0, i - 14):i - 2].reshape(-1, k), y[max(0, i - 14):i - 2].ravel()
    coef = np.linalg.solve(a.T @ a + np.eye(k), a.T @ b)
    np.testing.assert_allclose(last.loc[[str(s) for s in range(n)]], x[-1] @ coef, atol=1e-9)


def test_compared_methods_equal_single_ones(processed, returns):
    config = {"lookback_days": 12, "min_history_days": 6, "family_weights": {"gbt": 0.7},
              "stacking": {"refit_freq_days": 4, "alpha": 1.0}}
    holes = settle(processed.withColumn("neutral_score", F.when(F.crc32("stock_id") % 7 > 0, F.col("neutral_score"))))
    got = H.compare_methods(holes, config, returns, 1).toPandas().set_index(["method", *KEY]).ensemble_score
    assert set(got.index.get_level_values(0)) == set(H.METHODS)
    for method in H.METHODS:
        want = H.blend(holes, {**config, "method": method}, returns, 1)[0].toPandas().set_index(KEY).ensemble_score
        pd.testing.assert_series_equal(got.loc[method].sort_index(), want.sort_index(), check_names=False)
    with pytest.raises(ValueError):
        H.compare_methods(holes, config, returns, 1, ["other"])
    some = H.compare_methods(holes, config, returns.drop("future_return_1d"), 1, ["family"]).toPandas()
    assert len(some) == len(got.loc["family"])


def test_blend_errors_and_null_scores(spark, processed):
    with pytest.raises(ValueError):
        H.blend(processed, {"method": "other"})
    with pytest.raises(ValueError):
        H.blend(processed, {"method": "stacking"})
    rows = spark.createDataFrame(
        [(dt.date(2020, 1, 2), "a", "f", 2.0), (dt.date(2020, 1, 2), "a", "g", None),
         (dt.date(2020, 1, 2), "b", "x", 2.0)],
        "date date, stock_id string, model_family string, neutral_score double")
    out = {r.stock_id: r.ensemble_score
           for r in H.family_blend(rows, weights={"f": 0.5, "g": 0.5}).collect()}
    assert out == {"a": 1.0, "b": None}


def test_leg_sums_and_neutrality(panel, exposures):
    signal = panel.select(*KEY, F.col("factor_001").alias("signal_score"))
    for weighting in ("equal", "score"):
        legs = I.long_short_weights(signal, 0.2, 0.2, weighting).toPandas()
        sums = legs.groupby(["date", legs.weight > 0]).weight.sum().unstack()
        assert np.allclose(sums[True], 1) and np.allclose(sums[False], -1)
    weights = I.long_short_weights(signal, 0.2, 0.2)
    flat = I.neutralize_weights(weights, exposures, beta=True)
    tilt = flat.join(exposures, KEY).toPandas()
    tilt["xc"] = tilt.beta - tilt.groupby("date").beta.transform("mean")
    assert (tilt.weight * tilt.xc).groupby(tilt.date).sum().abs().max() < 1e-12
    with pytest.raises(ValueError):
        I.long_short_weights(signal, weighting="other")


def test_true_alpha_earns(panel, exposures):
    ahead = C.forward_returns(panel.select(*KEY, "close"), [1])
    signal = ahead.select(*KEY, F.col("future_return_1d").alias("signal_score"))
    out = I.long_short_backtest(signal, panel.select(*KEY, "return"), {"cost_rate": 0.0}, exposures)
    summary = out["summary"].first()
    assert summary.ann_return > 0 and summary.win_rate > 0.9
    daily = out["daily"].toPandas()
    assert np.allclose(daily.ls_ret, daily.ls_ret_net)
    assert out["monthly"].count() == len({d.strftime("%Y-%m") for d in daily.date})


def weights_of(spark, *rows):
    return spark.createDataFrame([(dt.date(2020, 1, d), s, w) for d, s, w in rows],
                                 "date date, stock_id string, weight double")


def test_turnover_of_a_stock_that_leaves_and_returns(spark):
    w = weights_of(spark, (1, "a", 1.0), (1, "b", -1.0), (2, "a", 1.0), (3, "a", 0.5), (3, "b", -1.0))
    def turn(mode):
        return [round(r.turnover, 9) for r in I.turnover_series(w, mode).orderBy("date").collect()]
    assert turn("calendar") == [2.0, 1.0, 1.5]
    assert turn("held_today") == [2.0, 0.0, 1.5]
    assert turn("row_lag") == [2.0, 0.0, 0.5]


def test_weeks_at_the_turn_of_the_year(spark):
    days = [dt.date(2024, 1, 2), dt.date(2024, 12, 27), dt.date(2024, 12, 30), dt.date(2025, 1, 2),
            dt.date(2025, 1, 6)]
    df = spark.createDataFrame([(d, "a", 1.0) for d in days], "date date, stock_id string, v double")
    kept = sorted(r.date for r in I.rebalance_rows(df, "weekly").collect())
    assert kept == [days[0], days[1], days[2], days[4]]
    assert sorted(r.date for r in I.rebalance_rows(df, "monthly").collect()) == [
        days[0], days[1], days[3]]
    with pytest.raises(ValueError):
        I.rebalance_rows(df, "yearly")


def test_structured_variance_equals_the_explicit_one(panel, exposures):
    day = panel.filter(F.col("date") == F.lit(panel.agg(F.min("date")).first()[0]))
    active = day.select(*KEY, (F.col("factor_001") / 100).alias("active_weight"))
    got = I.structured_risk(active, exposures, ["beta", "log_mktcap"]).first()
    pdf = day.toPandas()
    b = np.column_stack([pdf.beta, pdf.log_mktcap,
                         *[(pdf.industry == k).astype(float) for k in sorted(set(pdf.industry))]])
    cov = b @ (1e-4 * np.eye(b.shape[1])) @ b.T + np.diag(np.maximum(pdf.volatility ** 2 / 252, 1e-8))
    a = pdf.factor_001.to_numpy() / 100
    assert got.variance == pytest.approx(a @ cov @ a, rel=1e-10)
    assert got.tracking_error == pytest.approx((252 * (a @ cov @ a)) ** 0.5, rel=1e-10)


def test_benchmark_portfolio_held_as_benchmark_earns_minus_cost(panel):
    w = panel.select(*KEY, (F.col("benchmark_weight")).alias("weight"),
                     (F.col("benchmark_weight") * 2).alias("benchmark_weight"))
    out = I.benchmark_backtest(w, panel.select(*KEY, "return"), {"cost_rate": 0.001})
    daily = out["daily"].orderBy("date").toPandas()
    assert np.allclose(daily.excess_return, -daily.cost)
    assert daily.turnover[0] == pytest.approx(1) and daily.turnover[1:].abs().max() < 1e-12


def test_constraint_audit_flags_breaches(panel, exposures):
    w = panel.select(*KEY, F.when(F.col("stock_id") == "s000", 1.0).otherwise(0.0).alias("weight"),
                     "benchmark_weight")
    out = I.constraint_audit(w, exposures, {"max_weight": 0.5, "max_active_weight": 0.99},
                             ["beta"]).toPandas()
    ok = out.groupby("constraint").ok.mean()
    assert ok["budget"] == 1 and ok["non_negative"] == 1
    assert ok["max_weight"] == 0 and ok["max_active_weight"] == 1


def test_statistics_of_scores_do_not_rank(raw, panel, monkeypatch):
    from paneltide.functions import wide
    plans, real = [], wide.counted

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)
    monkeypatch.setattr(wide, "counted", seen)
    S.process_signals(raw, panel.select(*KEY, "industry", *STYLES), {})
    assert plans and not any("FlatMapGroupsInArrow" in p for p in plans)


def test_both_ranks_of_a_coefficient_take_one_pass(raw, panel):
    returns = C.forward_returns(panel.select(*KEY, "close"), [1]).drop("close")
    df = raw.join(returns, KEY)
    plan = G.daily_rank_ic(df, "raw_score", "future_return_1d", ["model_name"])._jdf.queryExecution().optimizedPlan().toString()
    # The pairs are stored, so neither counting nor ranking joins again.
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Join" not in plan
