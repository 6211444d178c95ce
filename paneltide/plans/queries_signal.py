"""Queries over signal processing, evaluation and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import ensemble as H
from paneltide.operators import evaluation as G
from paneltide.operators import labels as C
from paneltide.operators import signals as S
from paneltide.plans import panels as P
from paneltide.plans.catalog import query, tidy
from paneltide.plans.oracle import (avg_rank, bucket, clip, corr, drawdown, ols, pct, rounded,
                                    sql, zscore)
from paneltide.session import scratch_path, settle

KEY = ["date", "stock_id"]
MODEL_KEY = ["model_name", "date", "stock_id"]
M = "model_name, date"
LOOKBACK, MIN_HISTORY, REFIT = 12, 6, 3


def panel(spark, folder):
    return P.stored_months(spark, folder)


def signals(spark, folder):
    return P.raw_signals(panel(spark, folder))


def exposures(df):
    return df.select(*KEY, "industry", *P.STYLES)


def scored_panel(spark, folder):
    """factor_001 as the signal, next month's return as the outcome."""
    df = C.forward_returns(P.stored_months(spark, folder), [1])
    return settle(df.withColumnsRenamed({"factor_001": "signal", "future_return_1d": "ret"})
                  .select(*KEY, "industry", *P.STYLES, "signal", "ret"))


def processed(spark, folder):
    """(processed signals, panel) for the queries that need both."""
    df = panel(spark, folder)
    return settle(S.process_signals(P.raw_signals(df), exposures(df), {})), df


def _with_exposures(spark, folder):
    df = panel(spark, folder)
    return P.raw_signals(df).join(exposures(df), KEY)


# --- standardizing and neutralizing -----------------------------------------------------

@query("f1_rank_score", sql(f"""
SELECT model_name, date, stock_id, round({pct('raw_score', M)}, 6) AS rank_score FROM signals"""))
def _(spark, folder):
    return tidy(S.rank_score(signals(spark, folder), "raw_score", "rank_score")
                .select(*MODEL_KEY, "rank_score"))


@query("f2_zscore", sql(f"""
SELECT model_name, date, stock_id, round({zscore('raw_score', M)}, 6) AS zscore_score
FROM signals"""))
def _(spark, folder):
    return tidy(S.zscore(signals(spark, folder), "raw_score", "zscore_score")
                .select(*MODEL_KEY, "zscore_score"))


@query("f3_winsorize_score", sql(f"""
SELECT model_name, date, stock_id, round({clip('raw_score', M, 0.05, 0.95)}, 6) AS w
FROM signals"""))
def _(spark, folder):
    return tidy(S.winsorize_score(signals(spark, folder), "raw_score", "w", 0.05, 0.95)
                .select(*MODEL_KEY, "w"))


@query("f4_industry_neutral", sql("""
SELECT model_name, date, stock_id, round(raw_score - avg(raw_score) OVER
  (PARTITION BY model_name, date, industry), 6) AS neutral_score
FROM signals JOIN panel USING (date, stock_id)"""))
def _(spark, folder):
    return tidy(S.industry_neutral(_with_exposures(spark, folder), "raw_score", "neutral_score")
                .select(*MODEL_KEY, "neutral_score"))


@query("f5_style_neutral", sql(f"""
SELECT model_name, date, stock_id, {rounded('neutral_score')} FROM sn""", {
    "sx": "SELECT s.*, industry, log_mktcap, beta, turnover, volatility "
          "FROM signals s JOIN panel USING (date, stock_id)",
    "sn": ols("sx", "raw_score", "neutral_score", M)}))
def _(spark, folder):
    out = S.style_neutral(_with_exposures(spark, folder), "raw_score", "neutral_score", P.STYLES)
    return tidy(out.select(*MODEL_KEY, "neutral_score"))


_PROCESSED = sql(f"""
SELECT date, stock_id, model_family, model_name, model_version, label_type, horizon,
  objective_type, {rounded('raw_score', 'rank_score', 'zscore_score', 'neutral_score')}
FROM processed""")


@query("f6_process_signals", _PROCESSED)
def _(spark, folder):
    return tidy(processed(spark, folder)[0])


@query("f6_process_signal_store", sql(f"""
SELECT date, stock_id, model_name, {rounded('rank_score', 'zscore_score', 'neutral_score')}
FROM (SELECT *, zscore_score AS neutral_score FROM sig_z)"""))
def _(spark, folder):
    from paneltide.sources.panel_store import scan_panel, write_by_year
    raw, target = scratch_path(spark, "raw"), scratch_path(spark, "processed")
    write_by_year(P.raw_signals(P.supplier_months(spark, folder)), raw, overwrite=True,
                  also_by=["model_name"])
    S.process_signal_store(spark, raw, target, None, {})
    return tidy(scan_panel(spark, target).select(
        *KEY, "model_name", "rank_score", "zscore_score", "neutral_score"))


# --- evaluation of one signal -----------------------------------------------------------

_SCORED = {
    "sp": "SELECT p.date, p.stock_id, p.industry, log_mktcap, beta, turnover, volatility, "
          "factor_001 AS signal, future_return_1d AS ret FROM panel p JOIN future "
          "USING (date, stock_id)",
    "pairs": "SELECT * FROM sp WHERE signal IS NOT NULL AND ret IS NOT NULL",
    "ranked": f"SELECT *, {avg_rank('signal', 'date')} AS rs, {avg_rank('ret', 'date')} AS rr, "
              f"{bucket('signal', 'date', 5)} AS bucket FROM pairs",
    "ics": f"SELECT date, {corr('signal', 'ret')} AS ic, {corr('rs', 'rr')} AS rank_ic "
           "FROM ranked GROUP BY date",
    "grp": "SELECT date, bucket, avg(ret) AS group_return, count(*) AS n_stocks FROM ranked "
           "GROUP BY date, bucket",
    "ls": "SELECT t.date, t.group_return AS long_ret, b.group_return AS short_ret, "
          "t.group_return - b.group_return AS long_short_ret FROM grp t JOIN grp b "
          "ON t.date = b.date AND t.bucket = 4 AND b.bucket = 0",
    "lsd": drawdown("ls", "long_short_ret"),
    "top": f"SELECT * FROM (SELECT *, {bucket('signal', 'date', 5)} AS b FROM sp "
           "WHERE signal IS NOT NULL) WHERE b = 4",
    "topd": "SELECT date, stock_id, dense_rank() OVER (ORDER BY date) AS d FROM top",
    "turn": "SELECT a.date, 1 - count(b.stock_id) / count(*) AS turnover FROM topd a "
            "LEFT JOIN topd b ON a.stock_id = b.stock_id AND a.d = b.d + 1 WHERE a.d > 1 "
            "GROUP BY a.date",
}


@query("g1_daily_ic", sql("SELECT date, round(ic, 6) AS ic FROM ics", _SCORED))
def _(spark, folder):
    return tidy(G.daily_ic(scored_panel(spark, folder), "signal", "ret"))


@query("g2_daily_rank_ic", sql("SELECT date, round(rank_ic, 6) AS rank_ic FROM ics", _SCORED))
def daily_rank_ic(spark, folder):
    return tidy(G.daily_rank_ic(scored_panel(spark, folder), "signal", "ret"))


def _summary(column: str, source: str, keys: str = "") -> str:
    head, tail = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    icir = f"avg({column}) / nullif(stddev_samp({column}), 0)"
    return (f"SELECT {head}avg({column}) AS ic_mean, stddev_samp({column}) AS ic_std, "
            f"{icir} AS icir, {icir} * sqrt(count({column})) AS ic_tstat, "
            f"avg(CAST({column} > 0 AS INTEGER)) AS ic_positive_ratio, "
            f"count({column}) AS n_days FROM {source}{tail}")


@query("g3_ic_summary", sql(
    f"SELECT {rounded('ic_mean', 'ic_std', 'icir', 'ic_tstat', 'ic_positive_ratio')}, n_days "
    f"FROM ({_summary('ic', 'ics')})", _SCORED))
def _(spark, folder):
    return tidy(G.ic_summary(G.daily_ic(scored_panel(spark, folder), "signal", "ret")))


@query("g4_bucket", sql(f"""
SELECT date, stock_id, {bucket('signal', 'date', 10)} AS bucket FROM sp""", _SCORED))
def _(spark, folder):
    df = scored_panel(spark, folder).select(*KEY, "signal")
    return G.with_bucket(df, "signal", 10).drop("signal")


@query("g5_bucket_returns", sql("""
SELECT date, bucket, round(group_return, 6) AS group_return, n_stocks FROM grp""", _SCORED))
def _(spark, folder):
    return tidy(G.bucket_returns(scored_panel(spark, folder), "signal", "ret", 5))


@query("g6_long_short", sql(
    f"SELECT date, {rounded('long_ret', 'short_ret', 'long_short_ret')} FROM ls", _SCORED))
def _(spark, folder):
    return tidy(G.long_short(G.bucket_returns(scored_panel(spark, folder), "signal", "ret", 5), 5))


@query("g7_top_turnover", sql("SELECT date, round(turnover, 6) AS turnover FROM turn", _SCORED))
def _(spark, folder):
    return tidy(G.top_turnover(scored_panel(spark, folder), "signal", 0.2))


_USERS = {
    "utop": f"SELECT * FROM (SELECT *, {bucket('close', 'date', 5)} AS b FROM user_day) "
            "WHERE b = 4",
    "utopd": "SELECT date, stock_id, dense_rank() OVER (ORDER BY date) AS d FROM utop",
}


@query("g7_top_turnover_gaps", sql("""
SELECT a.date, round(1 - count(b.stock_id) / count(*), 6) AS turnover FROM utopd a
LEFT JOIN utopd b ON a.stock_id = b.stock_id AND a.d = b.d + 1 WHERE a.d > 1
GROUP BY a.date""", _USERS))
def _(spark, folder):
    return tidy(G.top_turnover(settle(P.user_days(spark, folder)), "close", 0.2))


@query("g8_max_drawdown", sql("SELECT round(max(fall), 6) AS max_drawdown FROM lsd", _SCORED))
def _(spark, folder):
    ls = G.long_short(G.bucket_returns(scored_panel(spark, folder), "signal", "ret", 5), 5)
    return tidy(G.drawdown(settle(ls), "long_short_ret"))


def _annual(ret: str, source: str, keys: str = "", prefix: str = "") -> str:
    head, tail = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    vol = f"stddev_samp({ret}) * sqrt(252)"
    return (f"SELECT {head}avg({ret}) * 252 AS ann_return, {vol} AS ann_vol, "
            f"avg({ret}) * 252 / nullif({vol}, 0) AS sharpe, "
            f"avg(CAST({ret} > 0 AS INTEGER)) AS win_rate, max(fall) AS max_drawdown "
            f"FROM {source}{tail}")


@query("g9_annualize", sql(
    f"SELECT {rounded('ann_return', 'ann_vol', 'sharpe', 'win_rate', 'max_drawdown')} "
    f"FROM ({_annual('long_short_ret', 'lsd')})", _SCORED))
def _(spark, folder):
    ls = settle(G.long_short(G.bucket_returns(scored_panel(spark, folder), "signal", "ret", 5), 5))
    return tidy(G.annualize(ls, "long_short_ret"))


@query("g10_exposure", sql("""
SELECT 'industry' AS exposure_type, industry AS name,
  round(coalesce(t.n / (SELECT count(*) FROM top), 0) - u.n / (SELECT count(*) FROM sp), 6)
    AS exposure
FROM (SELECT industry, count(*) AS n FROM sp GROUP BY industry) u
LEFT JOIN (SELECT industry, count(*) AS n FROM top GROUP BY industry) t USING (industry)"""
    + "".join(f" UNION ALL SELECT 'style', '{c}', round(avg({c}), 6) FROM top"
              for c in P.STYLES), _SCORED))
def _(spark, folder):
    out = G.exposure_of_top(scored_panel(spark, folder), "signal", styles=P.STYLES, quantile=0.2)
    return tidy(out.select("exposure_type", "name", "exposure"))


@query("g11_by_year", sql(f"""
SELECT year, {rounded('ic_mean', 'icir', 'rankic_mean', 'ls_ann_return', 'ls_max_drawdown')}
FROM (SELECT year(date) AS year, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir,
      avg(rank_ic) AS rankic_mean FROM ics GROUP BY year(date))
LEFT JOIN (SELECT year, avg(long_short_ret) * 252 AS ls_ann_return, max(fall) AS ls_max_drawdown
      FROM yls GROUP BY year) USING (year)""", {
    **_SCORED, "yl": "SELECT *, year(date) AS year FROM ls",
    "yls": drawdown("yl", "long_short_ret", "year")}))
def _(spark, folder):
    return tidy(G.yearly_performance(scored_panel(spark, folder), "signal", "ret"))


# --- evaluation of all signals ----------------------------------------------------------

_SERIES = "model_name, score_col"
_K = "model_name, score_col, date"
_EVALUATION = {
    "stk": "SELECT model_name, model_family, objective_type, label_type, horizon, score_col, "
           "p.date, p.stock_id, score, future_return_1d AS ret, x.industry, x.log_mktcap, x.beta,"
           " x.turnover, x.volatility FROM (UNPIVOT processed ON raw_score, rank_score, "
           "zscore_score, neutral_score INTO NAME score_col VALUE score) p "
           "JOIN future USING (date, stock_id) LEFT JOIN panel x USING (date, stock_id)",
    "mk": f"SELECT *, {bucket('score', _K, 10)} AS b10 FROM stk",
    "pr": f"SELECT *, {avg_rank('score', _K)} AS rs, {avg_rank('ret', _K)} AS rr, "
          f"{bucket('score', _K, 5)} AS bucket FROM mk WHERE score IS NOT NULL "
          "AND ret IS NOT NULL",
    "ev_ic": f"SELECT {_K}, {corr('score', 'ret')} AS ic, {corr('rs', 'rr')} AS rank_ic FROM pr "
             f"GROUP BY {_K}",
    "ev_grp": f"SELECT {_K}, bucket, avg(ret) AS group_return, count(*) AS n_stocks FROM pr "
              f"GROUP BY {_K}, bucket",
    "ev_ls": f"SELECT t.model_name, t.score_col, t.date, t.group_return AS long_ret, "
             "b.group_return AS short_ret, t.group_return - b.group_return AS long_short_ret "
             f"FROM ev_grp t JOIN ev_grp b USING ({_K}) WHERE t.bucket = 4 AND b.bucket = 0",
    "ev_lsd": drawdown("ev_ls", "long_short_ret", _SERIES),
    "ev_topd": f"SELECT {_K}, stock_id, dense_rank() OVER (PARTITION BY {_SERIES} ORDER BY date)"
               " AS d FROM mk WHERE b10 = 9",
    "ev_turn": "SELECT a.model_name, a.score_col, a.date, 1 - count(b.stock_id) / count(*) AS "
               "turnover FROM ev_topd a LEFT JOIN ev_topd b ON a.model_name = b.model_name AND "
               "a.score_col = b.score_col AND a.stock_id = b.stock_id AND a.d = b.d + 1 "
               "WHERE a.d > 1 GROUP BY a.model_name, a.score_col, a.date",
    "ev_sum": f"""SELECT * FROM
      (SELECT {_SERIES}, any_value(model_family) AS model_family,
        any_value(objective_type) AS objective_type, any_value(label_type) AS label_type,
        any_value(horizon) AS horizon FROM stk GROUP BY {_SERIES})
      JOIN (SELECT {_SERIES}, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir,
        avg(rank_ic) AS rank_ic_mean, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rank_icir
        FROM ev_ic GROUP BY {_SERIES}) USING ({_SERIES})
      JOIN (SELECT {_SERIES}, ann_return AS ls_ann_return, sharpe AS ls_sharpe,
        max_drawdown AS ls_max_drawdown FROM ({_annual('long_short_ret', 'ev_lsd', _SERIES)}))
        USING ({_SERIES})
      JOIN (SELECT {_SERIES}, avg(long_ret) * 252 AS long_ann_return FROM ev_ls
        GROUP BY {_SERIES}) USING ({_SERIES})
      JOIN (SELECT {_SERIES}, avg(turnover) AS top_turnover_mean FROM ev_turn
        GROUP BY {_SERIES}) USING ({_SERIES})""",
}
_MEASURES = ["ic_mean", "icir", "rank_ic_mean", "rank_icir", "ls_ann_return", "ls_sharpe",
             "ls_max_drawdown", "long_ann_return", "top_turnover_mean"]


def evaluation(spark, folder):
    table, df = processed(spark, folder)
    returns = C.forward_returns(df.select(*KEY, "close"), [1]).drop("close")
    return G.evaluate_signals(table, returns, exposures(df), 5, 0.1)


@query("g12_signal_report", sql(f"""
SELECT {_SERIES}, model_family, objective_type, label_type, horizon, {rounded(*_MEASURES)}
FROM ev_sum""", _EVALUATION))
def _(spark, folder):
    return tidy(evaluation(spark, folder)["model_summary"])


@query("g12_ic_timeseries", sql(f"SELECT {_K}, {rounded('ic', 'rank_ic')} FROM ev_ic",
                                _EVALUATION))
def _(spark, folder):
    return tidy(evaluation(spark, folder)["ic_timeseries"])


@query("g12_group_return", sql(f"SELECT {_K}, bucket, {rounded('group_return')}, n_stocks FROM ev_grp", _EVALUATION))
def _(spark, folder):
    return tidy(evaluation(spark, folder)["group_return"])


@query("g12_long_short_return", sql(f"SELECT {_K}, {rounded('long_ret', 'short_ret', 'long_short_ret')} FROM ev_ls", _EVALUATION))
def _(spark, folder):
    return tidy(evaluation(spark, folder)["long_short_return"])


@query("g12_turnover", sql(f"SELECT {_K}, {rounded('turnover')} FROM ev_turn", _EVALUATION))
def _(spark, folder):
    return tidy(evaluation(spark, folder)["turnover"])


@query("g12_yearly", sql(f"""
SELECT {_SERIES}, year, {rounded('ic_mean', 'icir', 'rankic_mean', 'ls_ann_return', 'ls_max_drawdown')}
FROM (SELECT {_SERIES}, year(date) AS year, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir,
      avg(rank_ic) AS rankic_mean FROM ev_ic GROUP BY ALL)
LEFT JOIN (SELECT {_SERIES}, year, avg(long_short_ret) * 252 AS ls_ann_return, max(fall) AS ls_max_drawdown
      FROM ev_yfall GROUP BY ALL) USING (model_name, score_col, year)""", {
    **_EVALUATION, "ev_y": "SELECT *, year(date) AS year FROM ev_ls",
    "ev_yfall": drawdown("ev_y", "long_short_ret", f"{_SERIES}, year")}))
def _(spark, folder):
    return tidy(evaluation(spark, folder)["yearly"])


@query("g12_exposure_report", sql(f"""
SELECT {_SERIES}, 'industry' AS exposure_type, industry AS name,
  round(coalesce(n_top / sum(n_top) OVER (PARTITION BY {_SERIES}), 0)
        - n / sum(n) OVER (PARTITION BY {_SERIES}), 6) AS exposure
FROM (SELECT {_SERIES}, industry, count(*) AS n, count(*) FILTER (WHERE b10 = 9) AS n_top
      FROM mk GROUP BY {_SERIES}, industry)""" + "".join(
    f" UNION ALL SELECT {_SERIES}, 'style', '{c}', round(avg({c}), 6) FROM mk WHERE b10 = 9 "
    f"GROUP BY {_SERIES}" for c in P.STYLES), _EVALUATION))
def _(spark, folder):
    return tidy(evaluation(spark, folder)["exposure_report"]
                .select("model_name", "score_col", "exposure_type", "name", "exposure"))


@query("g13_compare_models", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS level, "
    f"{rounded('ic_mean', 'rank_ic_mean', 'icir', 'ls_ann_return')} FROM "
    f"(SELECT {c}, avg(ic_mean) AS ic_mean, avg(rank_ic_mean) AS rank_ic_mean, avg(icir) AS icir,"
    f" avg(ls_ann_return) AS ls_ann_return FROM ev_sum GROUP BY {c})"
    for c in G.COMPARED), _EVALUATION))
def _(spark, folder):
    return tidy(G.compare_models(evaluation(spark, folder)["model_summary"]))


# --- ensembles --------------------------------------------------------------------------

@query("h1_pivot_scores", sql("SELECT date, stock_id, " + ", ".join(
    f"round(max(raw_score) FILTER (WHERE model_name = '{m}'), 6) AS {m}" for m in P.MODELS)
    + " FROM signals GROUP BY date, stock_id"))
def _(spark, folder):
    df = P.raw_signals(P.supplier_months(spark, folder))
    return tidy(H.pivot_scores(df, "raw_score", list(P.MODELS)))


@query("h2_equal_weight", sql("""
SELECT date, stock_id, round(avg(rank_score), 6) AS ensemble_score FROM sig_z
GROUP BY date, stock_id"""))
def _(spark, folder):
    ranked = S.process_signals(signals(spark, folder), None, {})
    return tidy(H.equal_weight(ranked, "rank_score"))


def _icir_tables(score: str, prefix: str, rank: bool) -> dict[str, str]:
    """Weights of each date from coefficients realized before it."""
    x, y = (("rs", "rr") if rank else (score, "future_return_1d"))
    frame = (f"(PARTITION BY model_name ORDER BY date ROWS BETWEEN {LOOKBACK - 1} PRECEDING "
             "AND CURRENT ROW)")
    lag = "lag({0}, 2) OVER (PARTITION BY model_name ORDER BY date)".format
    p = prefix
    return {
        f"{p}src": f"SELECT model_name, date, stock_id, {score}, future_return_1d FROM processed "
                   f"JOIN future USING (date, stock_id) WHERE {score} IS NOT NULL "
                   "AND future_return_1d IS NOT NULL",
        f"{p}rk": f"SELECT *, {avg_rank(score, M)} AS rs, {avg_rank('future_return_1d', M)} AS rr "
                  f"FROM {p}src",
        f"{p}ic": f"SELECT model_name, date, {corr(x, y)} AS ic FROM {p}rk GROUP BY {M}",
        f"{p}lag": f"SELECT model_name, date, {lag('ic')} AS lag_ic, {lag('date')} AS "
                   f"info_as_of_date FROM {p}ic",
        f"{p}icir": f"SELECT model_name, date, info_as_of_date, CASE WHEN count(lag_ic) OVER "
                    f"{frame} >= 2 THEN avg(lag_ic) OVER {frame} / "
                    f"nullif(stddev_samp(lag_ic) OVER {frame}, 0) END AS icir FROM {p}lag",
        f"{p}pos": f"SELECT *, greatest(coalesce(icir, 0), 0) AS w, "
                   f"dense_rank() OVER (ORDER BY date) - 1 AS day_no FROM {p}icir",
        f"{p}wts": f"SELECT date, model_name, icir, info_as_of_date, CASE WHEN "
                   f"day_no >= {MIN_HISTORY} AND sum(w) OVER (PARTITION BY date) > 0 THEN "
                   "w / sum(w) OVER (PARTITION BY date) ELSE 1.0 / count(*) OVER "
                   f"(PARTITION BY date) END AS weight FROM {p}pos",
        f"{p}ens": f"SELECT date, stock_id, coalesce(sum({score} * weight), 0) / "
                   f"nullif(sum(weight), 0) AS ensemble_score FROM processed JOIN {p}wts "
                   "USING (date, model_name) GROUP BY date, stock_id",
    }


_RANK_ICIR = _icir_tables("neutral_score", "ra", True)
_PLAIN_ICIR = _icir_tables("neutral_score", "pa", False)


def _ensemble_input(spark, folder):
    table, df = processed(spark, folder)
    returns = settle(C.forward_returns(df.select(*KEY, "close"), [1]).drop("close"))
    return table, returns


@query("h3_rolling_icir", sql(
    "SELECT date, model_name, round(icir, 6) AS icir, info_as_of_date FROM raicir", _RANK_ICIR))
def _(spark, folder):
    return tidy(H.rolling_icir(*_ensemble_input(spark, folder), 1, LOOKBACK))


@query("h4_lookahead_audit", sql("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE info_as_of_date >= date) AS n_leaks,
  count(*) FILTER (WHERE info_as_of_date IS NULL) AS n_uninformed FROM rawts""", _RANK_ICIR))
def _(spark, folder):
    icir = H.rolling_icir(*_ensemble_input(spark, folder), 1, LOOKBACK)
    weights = settle(H.icir_weights(icir, MIN_HISTORY))
    leaks = H.lookahead_audit(weights).agg(F.count(F.lit(1)).alias("n_leaks"))
    return weights.agg(F.count(F.lit(1)).alias("n_rows"),
                       F.count_if(F.col("info_as_of_date").isNull()).alias("n_uninformed")
                       ).crossJoin(leaks)


def _icir_query(prefix, tables, use_rank):
    name = "rankicir" if use_rank else "icir"

    @query(f"h5_{name}_weighted", sql(
        f"SELECT date, stock_id, round(ensemble_score, 6) AS ensemble_score FROM {prefix}ens",
        tables))
    def scores(spark, folder):
        return tidy(H.icir_weighted(*_ensemble_input(spark, folder), 1, LOOKBACK, MIN_HISTORY,
                                    use_rank=use_rank)[0])

    @query(f"h5_{name}_weights", sql(
        f"SELECT date, model_name, round(icir, 6) AS icir, info_as_of_date, "
        f"round(weight, 6) AS weight FROM {prefix}wts", tables))
    def weights(spark, folder):
        return tidy(H.icir_weighted(*_ensemble_input(spark, folder), 1, LOOKBACK, MIN_HISTORY,
                                    use_rank=use_rank)[1])


_icir_query("ra", _RANK_ICIR, True)
_icir_query("pa", _PLAIN_ICIR, False)

FAMILY_WEIGHTS = {"lightgbm": 0.6, "xgboost": 0.3}
_FAMILY = {
    "fam": "SELECT date, stock_id, model_family, avg(neutral_score) AS s FROM processed "
           "GROUP BY date, stock_id, model_family",
    "famens": "SELECT date, stock_id, coalesce(sum(s * w), 0) / nullif(sum(w), 0) AS "
              "ensemble_score FROM (SELECT *, CASE model_family WHEN 'lightgbm' THEN 0.6 WHEN "
              "'xgboost' THEN 0.3 ELSE 0.0 END AS w FROM fam) GROUP BY date, stock_id",
}


@query("h6_family_blend", sql("""
SELECT date, stock_id, round(CAST(ensemble_score AS DOUBLE), 6) AS ensemble_score
FROM famens""", _FAMILY))
def _(spark, folder):
    return tidy(H.family_blend(processed(spark, folder)[0], "neutral_score", FAMILY_WEIGHTS))


_PAST = (f"(ORDER BY date ROWS BETWEEN {2 + LOOKBACK} PRECEDING AND 3 PRECEDING)")
_CROSS = [(f"m{i}{j}", f"x{i} * x{j}") for i in range(3) for j in range(i, 3)] + [(f"v{i}", f"x{i} * y") for i in range(3)]


def _cramer(i: int) -> str:
    """Coefficient i of the ridge on the three models."""
    rows = [[f"(m{min(r, c)}{max(r, c)} + {int(r == c)})" for c in range(3)] for r in range(3)]
    swapped = [[f"v{r}" if c == i else rows[r][c] for c in range(3)] for r in range(3)]

    def det(m):
        return "(" + " + ".join(f"{m[0][a]} * ({m[1][b]} * {m[2][c]} - {m[1][c]} * {m[2][b]})"
                                for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1))) + ")"
    return f"{det(swapped)} / {det(rows)}"


_STACK = {
    "stw": "SELECT date, stock_id, " + ", ".join(
        f"max(neutral_score) FILTER (WHERE model_name = '{m}') AS x{i}" for i, m in enumerate(sorted(P.MODELS)))
           + " FROM processed GROUP BY date, stock_id",
    "sty": "SELECT w.*, future_return_1d AS y FROM stw w LEFT JOIN future USING (date, stock_id)",
    "std_": "SELECT date, count(*) FILTER (WHERE ok) AS n, " + ", ".join(
        f"coalesce(sum({product}) FILTER (WHERE ok), 0) AS {name}" for name, product in _CROSS)
            + " FROM (SELECT *, x0 + x1 + x2 + y IS NOT NULL AS ok FROM sty) GROUP BY date",
    "sts": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, " + ", ".join(
        f"coalesce(sum({c}) OVER {_PAST}, 0) AS {c}" for c in ("n", *(name for name, _ in _CROSS))) + " FROM std_",
    "str": "SELECT *, i > 2 AND n > 30 AS ready FROM sts",
    "stf": f"SELECT *, ready AND (i = (SELECT min(i) FROM str WHERE ready) OR i % {REFIT} = 0) AS fit FROM str",
    "stc": "SELECT date, " + ", ".join(f"last_value(CASE WHEN fit THEN {_cramer(i)} END IGNORE NULLS) OVER o AS b{i}" for i in range(3))
           + " FROM stf WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "stens": "SELECT date, stock_id, CASE WHEN b0 IS NULL THEN (" + " + ".join(f"coalesce(x{i}, 0)" for i in range(3))
             + ") / nullif(" + " + ".join(f"CAST(x{i} IS NOT NULL AS INTEGER)" for i in range(3)) + ", 0) ELSE "
             + " + ".join(f"coalesce(x{i}, 0) * b{i}" for i in range(3)) + " END AS ensemble_score FROM sty JOIN stc USING (date)",
}


@query("h7_stacking", sql(
    "SELECT date, stock_id, round(ensemble_score, 6) AS ensemble_score FROM stens", _STACK))
def _(spark, folder):
    return tidy(H.stacking(*_ensemble_input(spark, folder), 1, LOOKBACK, REFIT, 1.0))


_COMPARE = {
    **_RANK_ICIR, **_PLAIN_ICIR, **_FAMILY, **_STACK,
    "mth": "SELECT 'equal_rank' AS method, date, stock_id, avg(rank_score) AS ensemble_score "
           "FROM processed GROUP BY date, stock_id UNION ALL SELECT 'equal_neutral', date, "
           "stock_id, avg(neutral_score) FROM processed GROUP BY date, stock_id UNION ALL SELECT "
           "'icir_weighted', date, stock_id, ensemble_score FROM paens UNION ALL SELECT "
           "'rankicir_weighted', date, stock_id, ensemble_score FROM raens UNION ALL SELECT "
           "'family', date, stock_id, CAST(ensemble_score AS DOUBLE) FROM famens UNION ALL SELECT "
           "'stacking', date, stock_id, ensemble_score FROM stens",
    "mpr": "SELECT *, future_return_1d AS ret FROM mth JOIN future USING (date, stock_id) "
           "WHERE ensemble_score IS NOT NULL AND future_return_1d IS NOT NULL",
    # Scores equal in exact arithmetic may differ in the last digit of either engine.
    "mrk": "SELECT * REPLACE (round(ensemble_score, 9) AS ensemble_score) FROM mpr",
    "mrr": f"SELECT *, {avg_rank('ensemble_score', 'method, date')} AS rs, "
           f"{avg_rank('ret', 'method, date')} AS rr, "
           f"{bucket('ensemble_score', 'method, date', 5)} AS bucket FROM mrk",
    "mic": f"SELECT method, date, {corr('ensemble_score', 'ret')} AS ic, {corr('rs', 'rr')} AS "
           "rank_ic FROM mrr GROUP BY method, date",
    "mgr": "SELECT method, date, bucket, avg(ret) AS g FROM mrr GROUP BY method, date, bucket",
    "mls": "SELECT t.method, t.date, t.g - b.g AS long_short_ret FROM mgr t JOIN mgr b "
           "USING (method, date) WHERE t.bucket = 4 AND b.bucket = 0",
}


@query("h8_compare_methods", sql(f"""
SELECT method, {rounded('ic_mean', 'rank_ic_mean', 'ls_ann_return')} FROM
(SELECT method, avg(ic) AS ic_mean, avg(rank_ic) AS rank_ic_mean FROM mic GROUP BY method)
JOIN (SELECT method, avg(long_short_ret) * 252 AS ls_ann_return FROM mls GROUP BY method)
USING (method)""", _COMPARE))
def _(spark, folder):
    table, returns = _ensemble_input(spark, folder)
    config = {"lookback_days": LOOKBACK, "min_history_days": MIN_HISTORY, "family_weights": FAMILY_WEIGHTS,
              "stacking": {"refit_freq_days": REFIT, "alpha": 1.0}}
    scores = H.compare_methods(table, config, returns, 1)
    both = (scores.withColumn("ensemble_score", F.round("ensemble_score", 9))
            .join(returns, KEY).withColumnRenamed("future_return_1d", "ret"))
    return tidy(G.daily_results(both, "ensemble_score", "ret", 5, ["method"]).groupBy("method").agg(
        F.avg("ic").alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"),
        (F.avg("long_short_ret") * 252).alias("ls_ann_return")))
