"""Queries over walk-forward modelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.operators import labels as C
from paneltide.operators import modelling as E
from paneltide.operators import research as R
from paneltide.operators import splits as D
from paneltide.operators.preprocess import preprocess
from paneltide.plans import panels as P
from paneltide.plans.catalog import query, tidy
from paneltide.plans.oracle import avg_rank, bucket, clip, corr, rounded, sql, zscore
from paneltide.plans.queries_data import _BOUNDS, _anchored, shipping_days
from paneltide.plans.queries_signal import _EVALUATION, _K, _MEASURES, _SERIES
from paneltide.session import scratch_path, settle, stored
from paneltide.sources.panel_store import calendar
from paneltide.sources.signal_store import read_signals

KEY = ["date", "stock_id"]
FACTORS = P.FACTORS
YEARLY = {"train_years": 2, "valid_years": 1, "test_months": 12, "step_months": 12}
SMALL_GBT = {"maxIter": 5, "maxDepth": 3, "minInstancesPerNode": 5}


def _prepared(spark, folder):
    """(cleaned features, labels) of the supplier panel."""
    df = P.stored_months(spark, folder)
    features = settle(preprocess(df, FACTORS, {}, float32=False).select(*KEY, *FACTORS))
    raw = C.forward_return(df.select(*KEY, "close"), 1)
    labels = settle(C.rank_labels(raw, 1, kinds=("group",)).select(*KEY, "y_raw_1", "y_group_1"))
    return features, labels


def _windowed(spark, folder, features, labels):
    """Windows, stored labelled rows and the dates of the windows' splits."""
    windows = _anchored(spark, folder, D.rolling_windows, **YEARLY)
    rows = stored(features.join(labels, KEY), "labelled")
    return windows, rows, stored(D.split_dates(windows, calendar(labels), 1), "dates")


def _fits(spark, folder, names, label, family, params=None):
    """The fits of all windows."""
    return E.fit_windows(*_parts(spark, folder), names, label, "y_raw_1", family, params)


def _parts(spark, folder):
    windows, rows, dates = _windowed(spark, folder, *_prepared(spark, folder))
    return rows, windows, dates


def _together(fits, table):
    """The tables of all fits, with their window."""
    return reduce(DataFrame.unionByName, [
        table(result).withColumn("window_id", F.lit(window["window_id"])) for window, result in fits])


# Linear models of all windows in closed form. ``pe`` has the standardized factors, ``le`` the rows
# of the windows with the raw return and the bucket label.
def _two(label: str) -> str:
    """Least squares on factor_001 and factor_003 with an intercept, per window."""
    x, z, y = "coalesce(factor_001, 0)", "coalesce(factor_003, 0)", label
    c = "covar_pop({0}, {1})".format
    det = f"({c(x, x)} * {c(z, z)} - {c(x, z)} * {c(x, z)})"
    return (f"SELECT window_id, b1, b2, my - b1 * mx - b2 * mz AS b0 FROM (SELECT window_id, avg({x}) AS mx, avg({z}) AS mz, "
            f"avg({y}) AS my, ({c(z, z)} * {c(x, y)} - {c(x, z)} * {c(z, y)}) / {det} AS b1, "
            f"({c(x, x)} * {c(z, y)} - {c(x, z)} * {c(x, y)}) / {det} AS b2 FROM le WHERE split = 'train' "
            f"AND {y} IS NOT NULL GROUP BY window_id)")


_USED = ("factor_001", "factor_003")
_MODELS = {
    **_BOUNDS,
    "ew": "SELECT printf('w%03d_%s', n, strftime(a + INTERVAL (12 * n + 36) MONTH, '%Y%m%d')) AS window_id, "
          "CAST(a + INTERVAL (12 * n) MONTH AS DATE) AS train_start, CAST(a + INTERVAL (12 * n + 24) MONTH AS DATE) AS valid_start, "
          "CAST(a + INTERVAL (12 * n + 36) MONTH AS DATE) AS test_start, "
          "CAST(least(a + INTERVAL (12 * n + 48) MONTH - INTERVAL 1 DAY, b) AS DATE) AS test_end "
          "FROM bounds, (SELECT unnest(generate_series(0, 40)) AS n) WHERE a + INTERVAL (12 * n + 36) MONTH <= b",
    "ed": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS d FROM (SELECT DISTINCT date FROM panel)",
    "ei": "SELECT * FROM ed JOIN ew ON date BETWEEN train_start AND test_end",
    "ec": "SELECT window_id, max(d) FILTER (WHERE date < valid_start) AS t, max(d) FILTER (WHERE date < test_start) AS v "
          "FROM ei GROUP BY window_id",
    "es": "SELECT * FROM (SELECT date, window_id, CASE WHEN date < valid_start AND d <= t - 1 THEN 'train' WHEN date >= valid_start "
          "AND date < test_start AND d <= v - 1 THEN 'valid' WHEN date >= test_start THEN 'test' END AS split "
          "FROM ei JOIN ec USING (window_id)) WHERE split IS NOT NULL",
    "p1": "SELECT date, stock_id, " + ", ".join(f"{clip(c, 'date')} AS {c}" for c in _USED)
          + ", lead(close, 1) OVER (PARTITION BY stock_id ORDER BY date) / close - 1 AS y FROM panel",
    "p2": "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY date)) AS {c}" for c in _USED) + ") FROM p1",
    "pe": "SELECT * REPLACE (" + ", ".join(f"{zscore(c, 'date')} AS {c}" for c in _USED) + f"), {bucket('y', 'date', 5)} AS g FROM p2",
    "le": "SELECT * FROM pe JOIN es USING (date)",
    "lb": _two("y"), "lg": _two("g"),
    "lp": "SELECT le.*, b0 + b1 * coalesce(factor_001, 0) + b2 * coalesce(factor_003, 0) AS p FROM le JOIN lb USING (window_id)",
    "lv": f"SELECT *, {avg_rank('p', 'window_id, date')} AS rs, {avg_rank('y', 'window_id, date')} AS rr FROM lp "
          "WHERE split = 'valid' AND y IS NOT NULL",
    "lm": f"SELECT window_id, date, {corr('p', 'y')} AS ic, {corr('rs', 'rr')} AS rank_ic FROM lv GROUP BY window_id, date",
    "lq": "SELECT window_id, avg(ic) AS ic_valid, avg(ic) / nullif(stddev_samp(ic), 0) AS icir_valid, avg(rank_ic) AS rankic_valid, "
          "avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rankicir_valid FROM lm GROUP BY window_id",
}
USED = list(_USED)


def _coefficients(spark, fits):
    rows = [(w["window_id"], float(r["model"].intercept), *map(float, r["model"].coefficients)) for w, r in fits]
    return tidy(spark.createDataFrame(rows, "window_id string, intercept double, factor_001 double, factor_003 double"))


def _named(table: str) -> str:
    return (f"SELECT window_id, round(b0, 6) AS intercept, round(b1, 6) AS factor_001, round(b2, 6) AS factor_003 FROM {table}")


@query("e1_fit_linear", sql(_named("lb"), _MODELS))
def _(spark, folder):
    return _coefficients(spark, _fits(spark, folder, USED, "y_raw_1", "linear"))


@query("e1_fit_gbt")
def _(spark, folder):
    return _together(_fits(spark, folder, FACTORS, "y_raw_1", "gbt", SMALL_GBT), lambda r: r["predictions"])


@query("e1_fit_forest")
def _(spark, folder):
    return _together(_fits(spark, folder, FACTORS, "y_raw_1", "forest", {"numTrees": 5, "maxDepth": 3}),
                     lambda r: r["predictions"])


@query("e2_fit_relevance", sql(_named("lg"), _MODELS))
def _(spark, folder):
    """Pointwise fit on the bucket label."""
    return _coefficients(spark, _fits(spark, folder, USED, "y_group_1", "linear"))


@query("e3_linear_scores", sql(
    "SELECT window_id, date, stock_id, round(p, 6) AS raw_score FROM lp WHERE split = 'test'", _MODELS))
def _(spark, folder):
    return tidy(_together(_fits(spark, folder, USED, "y_raw_1", "linear"), lambda r: r["predictions"]))


_METRICS = ("ic_valid", "icir_valid", "rankic_valid", "rankicir_valid")


@query("e4_validation_metrics", sql(f"SELECT window_id, {rounded(*_METRICS)} FROM lq", _MODELS))
def _(spark, folder):
    fits = _fits(spark, folder, USED, "y_raw_1", "linear")
    return tidy(spark.createDataFrame([(w["window_id"], *(r[m] for m in _METRICS)) for w, r in fits],
                                      "window_id string, " + ", ".join(f"{m} double" for m in _METRICS)))


@query("e5_feature_importance", sql("""
SELECT window_id, 'factor_001' AS feature, round(abs(b1), 6) AS importance FROM lb
UNION ALL SELECT window_id, 'factor_003', round(abs(b2), 6) FROM lb""", _MODELS))
def _(spark, folder):
    return tidy(_together(_fits(spark, folder, USED, "y_raw_1", "linear"), lambda r: r["importance"]))


def _walk(spark, folder, mode):
    """Per window and model: the logged metric and the stored signals, read back."""
    features, labels = _prepared(spark, folder)
    # One row: the ends of the walk.
    span = shipping_days(spark, folder).agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    spec = {"label_type": "raw_return", "horizon": 1, "model_version": "v01"}
    config = {
        "rolling": {**YEARLY, "embargo_days": 1},
        "expanding": {"min_train_years": 3, "valid_years": 1, "test_months": 12,
                      "step_months": 12, "embargo_days": 1},
        "model_specs": [
            {**spec, "model_family": "linear", "objective_type": "regression"},
            {**spec, "model_family": "gbt", "objective_type": "ranking",
             "params": {"maxIter": 2, "maxDepth": 2}}],
    }
    signals = scratch_path(spark, "signals")
    log = E.walk_forward(features, labels, config, {"feature_version": "f01", "label_version": "l01"}, span[0], span[1],
                         scratch_path(spark, "models"), signals, USED, mode)
    read = read_signals(spark, signals).groupBy("window_id", "model_name").agg(
        F.count(F.lit(1)).alias("n_signals"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.max("rankic_valid").alias("stored_rankic"))
    linear = F.col("model_name").startswith("linear")
    return tidy(log.join(read, ["window_id", "model_name"], "full").select(
        "window_id", "model_name", "n_signals", "first_date", "last_date",
        F.when(linear, F.col("rankic_valid")).alias("rankic_valid"),
        (F.col("rankic_valid") == F.col("stored_rankic")).cast("int").alias("as_logged")))


_NAMES = "(SELECT unnest(['linear_reg_raw_h1_v01', 'gbt_rank_raw_h1_v01']) AS model_name)"
_READ = ("SELECT window_id, model_name, n_signals, first_date, last_date, CASE WHEN model_name LIKE 'linear%' THEN "
         "round(rankic_valid, 6) END AS rankic_valid, CAST(1 AS INTEGER) AS as_logged FROM (SELECT window_id, count(*) AS n_signals, "
         "min(date) AS first_date, max(date) AS last_date FROM le WHERE split = 'test' GROUP BY window_id) JOIN lq USING (window_id), "
         + _NAMES)


@query("e6_rolling_pipeline", sql(_READ, _MODELS))
def _(spark, folder):
    return _walk(spark, folder, "rolling")


_GROWING = {**_MODELS, "ew": _MODELS["ew"].replace("'w%03d_%s'", "'e%03d_%s'").replace(
    "CAST(a + INTERVAL (12 * n) MONTH AS DATE) AS train_start", "a AS train_start").replace(
    "12 * n + 48", "12 * n + 60").replace("12 * n + 36", "12 * n + 48").replace("12 * n + 24", "12 * n + 36")}


@query("e6_expanding_pipeline", sql(_READ, _GROWING))
def _(spark, folder):
    return _walk(spark, folder, "expanding")


@query("e7_checkpoint_reload", sql("""
SELECT window_id, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM le WHERE split = 'test' GROUP BY window_id""", _MODELS))
def _(spark, folder):
    """Scores of the models and of their stored copies: no difference."""
    rows, windows, dates = _parts(spark, folder)
    out = []
    for window, result in E.fit_windows(rows, windows, dates, FACTORS, "y_raw_1", None, "gbt", SMALL_GBT):
        root = scratch_path(spark, "model")
        E.save_model(result, spark.createDataFrame([(window["window_id"],)], "window_id string"), root)
        test = E.rows_of(rows, window, dates).filter("split = 'test'")
        both = result["predictions"].withColumnRenamed("raw_score", "first").join(
            E.predict(E.load_model("gbt", root), test, FACTORS), KEY)
        out.append(both.agg(F.lit(window["window_id"]).alias("window_id"), F.count(F.lit(1)).alias("n_rows"),
                            F.count_if(F.col("first") != F.col("raw_score")).alias("n_different")))
    return reduce(DataFrame.unionByName, out)


@query("e8_parameter_search")
def _(spark, folder):
    rows, windows, dates = _parts(spark, folder)
    first = windows.orderBy("test_start").first()
    space = {"maxDepth": {"type": "int", "low": 2, "high": 4},
             "stepSize": {"type": "float", "low": 0.05, "high": 0.3, "log": True}}
    return E.search(E.rows_of(rows, first, dates), FACTORS, "y_raw_1", space, None, "gbt", {"maxIter": 3}, trials=4,
                    halving=2)[1]


# The chain on fitted scores: two linear models that differ in objective, label and horizon.
_CHAIN = {
    **_MODELS, **_EVALUATION,
    "es": _MODELS["es"].replace("d <= t - 1", "d <= t - 5").replace("d <= v - 1", "d <= v - 5"),
    "p1": _MODELS["p1"].replace(" AS y FROM", " AS y, lead(close, 5) OVER (PARTITION BY stock_id ORDER BY date) / close - 1 AS y5 FROM"),
    "pe": _MODELS["pe"].replace(bucket("y", "date", 5), bucket("y5", "date", 5)),
    "signals": " UNION ALL ".join(
        f"SELECT date, stock_id, 'linear' AS model_family, '{name}' AS model_name, round(b0 + b1 * coalesce(factor_001, 0) + b2 * "
        f"coalesce(factor_003, 0), 9) AS raw_score, 'v01' AS model_version, '{label}' AS label_type, {horizon} AS horizon, "
        f"'{objective}' AS objective_type FROM le JOIN {fit} USING (window_id) WHERE split = 'test'"
        for name, objective, label, horizon, fit in (
            ("linear_reg_raw_h1_v01", "regression", "raw_return", 1, "lb"),
            ("linear_rank_indneu_h5_v01", "ranking", "industry_neutral_return", 5, "lg"))),
    "ahead": "SELECT date, stock_id, lead(close, 1) OVER o / close - 1 AS r1, lead(close, 5) OVER o / close - 1 AS r5 "
             "FROM panel WINDOW o AS (PARTITION BY stock_id ORDER BY date)",
    "stk": _EVALUATION["stk"].replace("future_return_1d AS ret", "CASE horizon WHEN 1 THEN r1 ELSE r5 END AS ret")
                             .replace("JOIN future", "JOIN ahead"),
}


def _chain(spark, folder) -> dict[str, str]:
    df = P.stored_months(spark, folder)
    features = settle(preprocess(df, FACTORS, {}, float32=False).select(*KEY, *FACTORS))
    raw = C.forward_return(C.forward_return(df.select(*KEY, "industry", "close"), 1), 5)
    labels = C.rank_labels(C.industry_neutral_return(raw, 5), 5, kinds=("group",))
    labels = settle(labels.select(*KEY, "y_raw_1", "y_group_5", "y_ind_neutral_5"))
    returns = settle(C.forward_returns(df.select(*KEY, "close"), [1, 5]).drop("close"))
    # One row: the ends of the walk.
    span = shipping_days(spark, folder).agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    spec = {"model_family": "linear", "model_version": "v01"}
    config = {
        "rolling": {**YEARLY, "embargo_days": 5}, "score_digits": 9,
        "model_specs": [
            {**spec, "objective_type": "regression", "label_type": "raw_return", "horizon": 1},
            {**spec, "objective_type": "ranking", "label_type": "industry_neutral_return", "horizon": 5}],
        "ensemble": [{"method": "equal_neutral"}],
    }
    return R.run_research(features, labels, returns, df.select(*KEY, "industry", *P.STYLES), config,
                          {"feature_version": "f01", "label_version": "l01"}, span[0], span[1],
                          scratch_path(spark, "research"), USED)


@query("p1_pipeline_summary", sql(f"""
SELECT {_SERIES}, model_family, objective_type, label_type, horizon, {rounded(*_MEASURES)} FROM ev_sum""", _CHAIN))
def _(spark, folder):
    """The summary of the report, read back from its CSV."""
    paths = _chain(spark, folder)
    schema = spark.read.parquet(paths["model_summary"]).schema
    return tidy(spark.read.csv(paths["model_summary_csv"], header=True, schema=schema))


@query("p1_pipeline_daily", sql(f"SELECT {_K}, {rounded('ic', 'rank_ic')} FROM ev_ic", _CHAIN))
def _(spark, folder):
    return tidy(spark.read.parquet(_chain(spark, folder)["ic_timeseries"]))


@query("p1_pipeline_ensemble", sql("""
SELECT date, stock_id, round(avg(neutral_score), 6) AS ensemble_score FROM processed GROUP BY date, stock_id""", _CHAIN))
def _(spark, folder):
    return tidy(spark.read.parquet(_chain(spark, folder)["ensemble_equal_neutral"]))
