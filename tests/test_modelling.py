"""Fitting, scoring, storing and searching on walk-forward splits."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.operators import labels as C
from paneltide.operators import modelling as E
from paneltide.operators.research import run_research
from paneltide.session import scratch_path, settle
from paneltide.sources.signal_store import read_signals

KEY = ["date", "stock_id"]
NAMES = ["factor_001", "factor_002"]


@pytest.fixture(scope="module")
def rows(panel):
    df = C.forward_return(panel, 1).select(*KEY, *NAMES, "y_raw_1")
    df = C.rank_labels(df, 1, kinds=("group",))
    days = [r.date for r in df.select("date").distinct().orderBy("date").collect()]
    split = (F.when(F.col("date") <= F.lit(days[35]), "train")
             .when(F.col("date").between(F.lit(days[37]), F.lit(days[46])), "valid")
             .when(F.col("date") >= F.lit(days[48]), "test"))
    return settle(df.withColumn("split", split).filter("split IS NOT NULL"))


@pytest.mark.parametrize("family, params", [
    ("gbt", {"maxIter": 4, "maxDepth": 2}), ("forest", {"numTrees": 4, "maxDepth": 3}),
    ("linear", {})])
def test_regression(rows, family, params):
    out = E.run_window(rows, NAMES, "y_raw_1", None, family, params)
    assert out["predictions"].columns == [*KEY, "raw_score"]
    assert out["predictions"].count() == rows.filter("split = 'test'").count()
    assert out["ic_valid"] > 0 and out["rankic_valid"] > 0 and out["best_iteration"] >= 0
    assert out["importance"].first().feature == "factor_001"


def test_relevance_fit_is_measured_on_returns(rows):
    out = E.run_window(rows, NAMES, "y_group_1", "y_raw_1", "gbt", {"maxIter": 3, "maxDepth": 2})
    assert out["rankic_valid"] > 0


def test_reload_gives_the_same_scores(spark, rows):
    out = E.run_window(rows, NAMES, "y_raw_1", None, "gbt", {"maxIter": 3, "maxDepth": 2})
    root = scratch_path(spark, "model")
    E.save_model(out, spark.range(1), root)
    again = E.predict(E.load_model("gbt", root), rows.filter("split = 'test'"), NAMES)
    assert again.exceptAll(out["predictions"]).isEmpty()


def test_search_is_seeded_and_keeps_the_best(rows):
    space = {"regParam": {"type": "float", "low": 1e-4, "high": 10.0, "log": True}}
    best, trials = E.search(rows, NAMES, "y_raw_1", space, None, "linear", trials=2, seed=1)
    again, _ = E.search(rows, NAMES, "y_raw_1", space, None, "linear", trials=2, seed=1)
    assert best == again and trials.count() == 2
    top = trials.orderBy(F.desc("rankic_valid"), "trial_number").first()
    assert float(top.p_regParam) == best["regParam"]


@pytest.mark.parametrize("space", [{"a": {"low": 1}}, {"a": {"type": "int", "low": 1}},
                                   {"a": {"type": "other"}}, {"a": {"type": "categorical"}}])
def test_search_space_errors(space):
    with pytest.raises(ValueError):
        E.check_space(space)


def test_names_and_labels():
    assert E.model_name("lightgbm", "regression", "excess_return", 5, "01") == "lgbm_reg_excess_h5_v01"
    assert E.training_labels("ranking", "residual_return", 5) == ("y_group_5", "y_residual_5")
    assert E.training_labels("regression", "rank_return", 1) == ("y_rank_1", "y_excess_1")


def test_walk_forward_stores_models_and_signals(spark, panel):
    labels = settle(C.forward_return(panel, 1).select(*KEY, "y_raw_1"))
    # Stretch the calendar: one business day becomes a month.
    order = panel.select("date").distinct().selectExpr("date", "row_number() OVER (ORDER BY date) AS n")
    month = order.select("date", F.expr("add_months(date'2010-01-01', n - 1)").alias("m"))
    def stretch(df):
        return settle(df.join(month, "date").drop("date").withColumnRenamed("m", "date"))
    features, labels = stretch(panel.select(*KEY, *NAMES)), stretch(labels)
    config = {"rolling": {"train_years": 2, "valid_years": 1, "test_months": 12,
                          "step_months": 12, "embargo_days": 1},
              "model_specs": [{"model_family": "linear", "objective_type": "regression",
                               "label_type": "raw_return", "horizon": 1, "model_version": "v01"}]}
    models, signals = scratch_path(spark, "models"), scratch_path(spark, "signals")
    log = E.walk_forward(features, labels, config, {"feature_version": "f01", "label_version": "l01"},
                         "2010-01-01", "2014-12-31", models, signals)
    rows = log.collect()
    assert [r.window_id for r in rows] == ["w000_20130101", "w001_20140101"]
    stored = read_signals(spark, signals, "linear_reg_raw_h1_v01")
    assert stored.count() == 24 * 30 and stored.select(*KEY).distinct().count() == 24 * 30
    meta = spark.read.parquet(f"{models}/linear_reg_raw_h1_v01/w000_20130101/meta").first()
    assert meta.ic_valid == rows[0].ic_valid


def test_research_report_reads_back_in_both_formats(spark, panel):
    order = panel.select("date").distinct().selectExpr("date", "row_number() OVER (ORDER BY date) AS n")
    month = order.select("date", F.expr("add_months(date'2010-01-01', n - 1)").alias("m"))
    df = settle(panel.join(month, "date").drop("date").withColumnRenamed("m", "date"))
    labels = settle(C.rank_labels(C.forward_return(C.forward_return(df.select(*KEY, "close"), 1), 5), 5, kinds=("group",))
                    .select(*KEY, "y_raw_1", "y_raw_5", "y_group_5"))
    returns = settle(C.forward_returns(df.select(*KEY, "close"), [1, 5]).drop("close"))
    spec = {"model_family": "linear", "label_type": "raw_return", "model_version": "v01"}
    config = {"rolling": {"train_years": 2, "valid_years": 1, "test_months": 12, "step_months": 12, "embargo_days": 5},
              "model_specs": [{**spec, "objective_type": "regression", "horizon": 1},
                              {**spec, "objective_type": "ranking", "horizon": 5}],
              "ensemble": [{"method": "equal_rank"}, {"method": "icir_weighted", "horizon": 1, "lookback_days": 6}]}
    paths = run_research(settle(df.select(*KEY, *NAMES)), labels, returns, df.select(*KEY, "industry", "beta"), config,
                         {"feature_version": "f01", "label_version": "l01"}, "2010-01-01", "2014-12-31",
                         scratch_path(spark, "research"), NAMES)
    read = {name: spark.read.parquet(path) for name, path in paths.items() if not name.endswith("_csv")}
    assert {"ic_timeseries", "group_return", "long_short_return", "turnover", "yearly", "exposure_report", "model_summary",
            "train_log", "ensemble_equal_rank", "ensemble_icir_weighted", "weights_icir_weighted"} <= set(read)
    for name, path in paths.items():
        if name.endswith("_csv"):
            table = read[name.removesuffix("_csv")]
            again = spark.read.csv(path, header=True, schema=table.schema)
            assert again.count() == table.count() and again.exceptAll(table).isEmpty()
            assert len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".csv")]) == 1
    assert {r.level for r in read["compare_horizon"].collect()} == {"1", "5"}
    assert read["train_log"].count() == 4 and read["model_summary"].count() == 8
    # The scores in the report are those of the fitted models: the factor that drives the return leads.
    best = {r.horizon: r.rank_ic_mean for r in read["model_summary"].where("score_col = 'raw_score'").collect()}
    assert best[1] > 0.3
    assert read["ensemble_equal_rank"].count() == read["signals"].select(*KEY).distinct().count()


SPACE = {"regParam": {"type": "float", "low": 1e-4, "high": 10.0, "log": True}}


def test_search_minimizes_and_halves(rows):
    best, trials = E.search(rows, NAMES, "y_raw_1", SPACE, None, "linear", trials=3, seed=1, direction="minimize")
    low = trials.orderBy("rankic_valid", "trial_number").first()
    assert float(low.p_regParam) == best["regParam"]
    best, trials = E.search(rows, NAMES, "y_raw_1", SPACE, None, "linear", trials=4, seed=1, halving=2)
    found = {r.trial_number: r for r in trials.collect()}
    assert sorted(r.rung for r in found.values()) == [0, 0, 1, 2]
    top = max(found.values(), key=lambda r: r.rung)
    assert top.status == "complete" and float(top.p_regParam) == best["regParam"]
    for wrong in ({"direction": "up"}, {"halving": 1}):
        with pytest.raises(ValueError):
            E.search(rows, NAMES, "y_raw_1", SPACE, trials=1, **wrong)


def test_search_stops_at_its_timeout(rows, monkeypatch):
    """A fit that never ends is cancelled; the table has all trials."""
    def endless(*args):
        while True:
            rows.count()

    monkeypatch.setattr(E, "fit", endless)
    start = time.monotonic()
    best, trials = E.search(rows, NAMES, "y_raw_1", SPACE, None, "linear", {"maxIter": 7}, trials=3, timeout=2.0)
    assert time.monotonic() - start < 60
    assert [r.status for r in trials.orderBy("trial_number").collect()] == ["timeout"] * 3
    assert best == {"maxIter": 7}


def test_side_by_side_keeps_order_and_raises(spark):
    def slow(n):
        return lambda: (time.sleep(.2 * (3 - n)), spark.range(n + 1).count())[1]

    assert E.side_by_side(spark, [(str(n), slow(n)) for n in range(4)], 2) == [1, 2, 3, 4]

    def broken():
        raise KeyError("broken")

    with pytest.raises(KeyError):
        E.side_by_side(spark, [("a", broken), ("b", slow(0)), ("c", slow(1))], 2)


def test_measuring_a_model_ranks_and_predicts_once(spark, monkeypatch):
    from paneltide.operators import evaluation as G
    passes, real = [], G.settle

    def seen(df):
        passes.append(df)
        return real(df)
    monkeypatch.setattr(G, "settle", seen)
    rows = spark.range(60).selectExpr("DATE'2020-01-01' + CAST(id % 3 AS INT) AS date", "CAST(id AS STRING) AS stock_id",
                                      "CAST(hash(id) AS DOUBLE) AS raw_score", "CAST(hash(id, 7) AS DOUBLE) AS y")
    found = E.validation_metrics(rows, "y").first()
    assert len(passes) == 1
    pdf = rows.toPandas()
    days = [g for _, g in pdf.groupby("date")]
    assert abs(found["ic_valid"] - np.mean([g.raw_score.corr(g.y) for g in days])) < 1e-12
    assert abs(found["rankic_valid"] - np.mean([g.raw_score.rank().corr(g.y.rank()) for g in days])) < 1e-12
