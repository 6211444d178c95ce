"""Queries over portfolio accounting, exposure and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import portfolio as I
from paneltide.plans import panels as P
from paneltide.plans.catalog import query, tidy
from paneltide.plans.oracle import drawdown, pct, rounded, sql
from paneltide.plans.queries_signal import _annual
from paneltide.session import settle
from paneltide.sources.panel_store import calendar

KEY = ["date", "stock_id"]
RISK_STYLES = ["log_mktcap", "beta", "volatility"]


def panel(spark, folder):
    return P.with_returns(P.stored_months(spark, folder))


def signal(df):
    return df.select(*KEY, F.col("factor_001").alias("signal_score"))


def exposures(df):
    return df.select(*KEY, "industry", *P.STYLES)


@query("i1_next_returns", sql("""
SELECT date, stock_id, round(lead(return) OVER (PARTITION BY stock_id ORDER BY date), 6)
  AS next_return FROM panel_r"""))
def _(spark, folder):
    df = P.with_returns(P.stored_months(spark, folder)).select(*KEY, "return")
    return tidy(I.next_returns(df).drop("return"))


def _legs(source: str, score: str, weighting: str, q: float = 0.1) -> dict[str, str]:
    size = {"equal": "1.0", "score": "CASE WHEN side > 0 THEN s - min(s) OVER k ELSE "
                                     "max(s) OVER k - s END + 1e-12"}[weighting]
    return {
        "pc": f"SELECT date, stock_id, {score} AS s, {pct(score, 'date')} AS p FROM {source} "
              f"WHERE {score} IS NOT NULL",
        "sd": f"SELECT date, stock_id, s, 1 AS side FROM pc WHERE p >= 1.0 - {q} UNION ALL "
              f"SELECT date, stock_id, s, -1 FROM pc WHERE p <= {q}",
        "sz": f"SELECT *, CAST({size} AS DOUBLE) AS size FROM sd WINDOW k AS "
              "(PARTITION BY date, side)",
        "wt": "SELECT date, stock_id, side * size / sum(size) OVER (PARTITION BY date, side) "
              "AS weight FROM sz",
    }


_LEGS = _legs("panel", "factor_001", "equal")
_TILTED = _legs("panel", "factor_001", "score")


@query("i2_long_short_weights", sql(
    "SELECT date, stock_id, round(weight, 6) AS weight FROM wt", _LEGS))
def _(spark, folder):
    return tidy(I.long_short_weights(signal(panel(spark, folder))))


@query("i2_score_weights", sql(
    "SELECT date, stock_id, round(weight, 6) AS weight FROM wt", _TILTED))
def _(spark, folder):
    return tidy(I.long_short_weights(signal(panel(spark, folder)), weighting="score"))


def _project(source: str, column: str) -> str:
    return (f"SELECT * REPLACE (weight - xc * sum(weight * xc) OVER (PARTITION BY date) / "
            f"greatest(sum(xc * xc) OVER (PARTITION BY date), 1e-12) AS weight) FROM "
            f"(SELECT * EXCLUDE (x), x - avg(x) OVER (PARTITION BY date) AS xc FROM "
            f"(SELECT *, coalesce({column}, 0) AS x FROM {source}))")


_NEUTRAL = {
    **_TILTED,
    "nx": "SELECT wt.*, industry, log_mktcap, beta FROM wt LEFT JOIN panel "
          "USING (date, stock_id)",
    "ni": "SELECT * REPLACE (greatest(weight, 0) / greatest(sum(greatest(weight, 0)) OVER "
          "(PARTITION BY date, industry), 1e-12) - greatest(-weight, 0) / "
          "greatest(sum(greatest(-weight, 0)) OVER (PARTITION BY date, industry), 1e-12) "
          "AS weight) FROM nx",
    "nn": "SELECT * REPLACE (weight / greatest(sum(greatest(weight, 0)) OVER "
          "(PARTITION BY date), 1e-12) AS weight) FROM ni",
    "ns": _project("nn", "log_mktcap"),
    "nb": _project("(SELECT * EXCLUDE (xc) FROM ns)", "beta"),
}


@query("i3_neutral_weights", sql(
    "SELECT date, stock_id, round(weight, 6) AS weight FROM nb", _NEUTRAL))
def _(spark, folder):
    df = panel(spark, folder)
    weights = I.long_short_weights(signal(df), weighting="score")
    return tidy(I.neutralize_weights(weights, exposures(df), True, True, True))


def _returns_of(weights: str) -> str:
    return f"""SELECT date, sum(CASE WHEN weight > 0 THEN g ELSE 0 END) AS long_ret,
  sum(CASE WHEN weight < 0 THEN g ELSE 0 END) AS short_ret,
  sum(CASE WHEN weight > 0 THEN g ELSE 0 END) + sum(CASE WHEN weight < 0 THEN g ELSE 0 END)
    AS ls_ret
FROM (SELECT w.date, weight, weight * coalesce(nr, 0) AS g FROM {weights} w
  LEFT JOIN nxt USING (date, stock_id)) GROUP BY date"""


_NEXT = {"nxt": "SELECT date, stock_id, lead(return) OVER (PARTITION BY stock_id ORDER BY date) "
                "AS nr FROM panel_r"}


@query("i4_long_short_return", sql(
    f"SELECT date, {rounded('long_ret', 'short_ret', 'ls_ret')} FROM ({_returns_of('wt')})",
    {**_LEGS, **_NEXT}))
def _(spark, folder):
    df = panel(spark, folder)
    return tidy(I.long_short_return(I.long_short_weights(signal(df)), df.select(*KEY, "return")))


def _turnover_of(weights: str, prefix: str = "t") -> dict[str, str]:
    return {
        f"{prefix}d": f"SELECT *, dense_rank() OVER (ORDER BY date) AS d FROM {weights}",
        f"{prefix}n": f"SELECT DISTINCT date, d FROM {prefix}d",
        f"{prefix}p": f"SELECT n.date, p.stock_id, p.weight FROM {prefix}d p JOIN {prefix}n n "
                      "ON n.d = p.d + 1",
        f"{prefix}o": f"SELECT coalesce(a.date, b.date) AS date, "
                      "sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover "
                      f"FROM {prefix}d a FULL JOIN {prefix}p b ON a.date = b.date AND "
                      "a.stock_id = b.stock_id GROUP BY ALL",
        f"{prefix}h": f"SELECT a.date, sum(abs(a.weight - coalesce(b.weight, 0))) AS turnover "
                      f"FROM {prefix}d a LEFT JOIN {prefix}p b ON a.date = b.date AND "
                      "a.stock_id = b.stock_id GROUP BY a.date",
    }


@query("i5_turnover", sql("SELECT date, round(turnover, 6) AS turnover FROM t_o", {
    **_LEGS, **_turnover_of("wt", "t_")}))
def _(spark, folder):
    return tidy(I.turnover_series(settle(I.long_short_weights(signal(panel(spark, folder))))))


@query("i5_turnover_row_lag", sql("""
SELECT date, round(sum(abs(weight - coalesce(prev, 0))), 6) AS turnover FROM
(SELECT *, lag(weight) OVER (PARTITION BY stock_id ORDER BY date) AS prev FROM wt)
GROUP BY date""", _LEGS))
def _(spark, folder):
    weights = settle(I.long_short_weights(signal(panel(spark, folder))))
    return tidy(I.turnover_series(weights, "row_lag"))


_UW = {"uw": "SELECT date, stock_id, close / sum(close) OVER (PARTITION BY date) AS weight "
             "FROM user_day"}


@query("i5_turnover_gaps", sql("SELECT date, round(turnover, 6) AS turnover FROM u_o",
                               {**_UW, **_turnover_of("uw", "u_")}))
def _(spark, folder):
    from paneltide.functions.lookup import attach
    df = settle(P.user_days(spark, folder))
    totals = df.groupBy("date").agg(F.sum("close").alias("t"))
    weights = attach(df, totals, ["date"]).select(*KEY, (F.col("close") / F.col("t"))
                                                  .alias("weight"))
    return tidy(I.turnover_series(weights))


@query("i6_rebalance_weekly", sql("""
SELECT date, stock_id, n_events FROM user_day WHERE date IN
(SELECT min(date) FROM user_day GROUP BY isoyear(date), weekofyear(date))"""))
def _(spark, folder):
    return I.rebalance_rows(P.user_days(spark, folder).select(*KEY, "n_events"), "weekly")


_QUARTER = {"uwk": "SELECT d.date AS held_on, min(d.date) OVER (PARTITION BY isoyear(d.date), "
                   "weekofyear(d.date)) AS reb FROM (SELECT DISTINCT date FROM user_day) d"}


@query("i6_hold_between", sql("""
SELECT held_on AS date, stock_id, n_events FROM user_day JOIN uwk ON date = reb""", _QUARTER))
def _(spark, folder):
    df = settle(P.user_days(spark, folder).select(*KEY, "n_events"))
    return I.hold_weights(I.rebalance_rows(df, "weekly"), calendar(df), "weekly")


CONFIG = {"industry_neutral": True, "mktcap_neutral": True, "beta_neutral": True,
          "weighting": "score", "cost_rate": 0.0015}
_BACKTEST = {
    **_NEUTRAL, **_NEXT, **_turnover_of("nb", "b_"), "br": _returns_of("nb"),
    "bd": "SELECT br.*, turnover, ls_ret - turnover * 0.0015 AS ls_ret_net FROM br JOIN b_o "
          "USING (date)",
    "bdg": drawdown("bd", "ls_ret"),
    "bdn": drawdown("bd", "ls_ret_net"),
}


def _backtest(spark, folder):
    df = panel(spark, folder)
    return I.long_short_backtest(signal(df), df.select(*KEY, "return"), CONFIG, exposures(df))


@query("i7_long_short_backtest", sql(
    f"SELECT date, {rounded('long_ret', 'short_ret', 'ls_ret', 'turnover', 'ls_ret_net')} "
    "FROM bd", _BACKTEST))
def _(spark, folder):
    return tidy(_backtest(spark, folder)["daily"])


@query("i8_performance", sql(f"""
SELECT {rounded('ann_return', 'ann_vol', 'sharpe', 'max_drawdown', 'win_rate', 'ann_return_net',
                'sharpe_net', 'long_ann_return', 'short_ann_return', 'avg_turnover')}
FROM ({_annual('ls_ret', 'bdg')}),
 (SELECT ann_return AS ann_return_net, sharpe AS sharpe_net
  FROM ({_annual('ls_ret_net', 'bdn')})),
 (SELECT avg(long_ret) * 252 AS long_ann_return, avg(short_ret) * 252 AS short_ann_return,
  avg(turnover) AS avg_turnover FROM bd)""", _BACKTEST))
def _(spark, folder):
    return tidy(_backtest(spark, folder)["summary"])


@query("i8_monthly_returns", sql("""
SELECT strftime(date, '%Y-%m') AS month, round(sum(ls_ret), 6) AS monthly_return
FROM bd GROUP BY 1""", _BACKTEST))
def _(spark, folder):
    return tidy(_backtest(spark, folder)["monthly"])


_BENCH = """volume / sum(volume) OVER (PARTITION BY date)"""
_GIVEN = {
    "gw": "SELECT date, stock_id, industry, log_mktcap, beta, volatility, turnover, adv, "
          "factor_001 AS alpha_score, volume * (1 + factor_004) / sum(volume * (1 + factor_004)) "
          f"OVER (PARTITION BY date) AS weight, {_BENCH} AS bench FROM panel",
    "ga": "SELECT *, weight - bench AS active FROM gw",
}


def given_weights(df):
    """A long-only portfolio tilted by factor_004, with its volume benchmark."""
    from paneltide.functions.lookup import attach
    tilt = F.col("volume") * (1 + F.col("factor_004"))
    totals = df.groupBy("date").agg(F.sum(tilt).alias("_t"), F.sum("volume").alias("_v"))
    return settle(attach(df, totals, ["date"]).select(
        *KEY, (tilt / F.col("_t")).alias("weight"),
        (F.col("volume") / F.col("_v")).alias("benchmark_weight"),
        F.col("factor_001").alias("alpha_score"), "adv"))


@query("i9_industry_exposure", sql("""
SELECT date, industry, round(sum(weight), 6) AS industry_weight FROM gw
GROUP BY date, industry""", _GIVEN))
def _(spark, folder):
    df = panel(spark, folder)
    return tidy(I.industry_exposure(given_weights(df), exposures(df)))


@query("i10_active_industry", sql("""
SELECT date, industry, round(sum(weight), 6) AS port_w, round(sum(bench), 6) AS bench_w,
  round(sum(weight) - sum(bench), 6) AS active_w FROM gw GROUP BY date, industry""", _GIVEN))
def _(spark, folder):
    df = panel(spark, folder)
    weights = given_weights(df)
    return tidy(I.active_industry_exposure(weights, weights, exposures(df)))


@query("i11_style_exposure", sql("SELECT date, " + ", ".join(
    f"round(sum(coalesce({c}, 0) * weight), 6) AS {c}" for c in RISK_STYLES)
    + " FROM gw GROUP BY date", _GIVEN))
def _(spark, folder):
    df = panel(spark, folder)
    return tidy(I.style_exposure(given_weights(df), exposures(df), RISK_STYLES))


_RELATIVE = {
    **_GIVEN, **_NEXT, **_turnover_of("gw", "g_"),
    "gs": "SELECT ga.date, sum(weight * coalesce(nr, 0)) AS gross, sum(bench * coalesce(nr, 0)) "
          "AS benchmark_return, sum(alpha_score * active) AS expected_alpha FROM ga "
          "LEFT JOIN nxt USING (date, stock_id) GROUP BY ga.date",
    "gd": "SELECT date, gross - turnover * 0.0015 AS portfolio_return, benchmark_return, "
          "turnover, turnover * 1e8 AS traded_value, expected_alpha, turnover * 0.0015 AS cost, "
          "gross - turnover * 0.0015 - benchmark_return AS excess_return FROM gs JOIN g_h "
          "USING (date)",
    "gdd": drawdown("gd", "excess_return"),
}


def _relative(spark, folder):
    df = panel(spark, folder)
    return I.benchmark_backtest(given_weights(df), df.select(*KEY, "return"),
                                {"cost_rate": 0.0015}, exposures(df))


@query("i12_benchmark_backtest", sql(f"""
SELECT date, {rounded('portfolio_return', 'benchmark_return', 'turnover', 'expected_alpha',
                      'cost', 'excess_return')}, round(traded_value, 2) AS traded_value
FROM gd""", _RELATIVE))
def _(spark, folder):
    daily = _relative(spark, folder)["daily"]
    return tidy(daily.drop("traded_value")).join(
        tidy(daily.select("date", "traded_value"), 2), "date")


@query("i12_benchmark_summary", sql(f"""
SELECT {rounded('ann_excess_return', 'tracking_error', 'information_ratio', 'avg_turnover',
                'max_drawdown')} FROM
(SELECT avg(excess_return) * 252 AS ann_excess_return,
  stddev_samp(excess_return) * sqrt(252) AS tracking_error,
  avg(excess_return) * 252 / nullif(stddev_samp(excess_return) * sqrt(252), 0)
    AS information_ratio, avg(turnover) AS avg_turnover, max(fall) AS max_drawdown FROM gdd)""",
                                    _RELATIVE))
def _(spark, folder):
    return tidy(_relative(spark, folder)["summary"])


# Volatility is scaled so that it looks like an annual one.
_RISK = {
    **_GIVEN,
    "rk": "SELECT * REPLACE (volatility / 1e5 AS volatility) FROM ga",
    "rl": " UNION ALL ".join(
        f"SELECT date, '{c}' AS factor, sum(coalesce({c}, 0) * active) AS b FROM rk GROUP BY date"
        for c in RISK_STYLES)
          + " UNION ALL SELECT date, 'industry_' || industry, sum(active) FROM rk "
            "GROUP BY date, industry",
    "rv": "SELECT date, coalesce(volatility, median(volatility) OVER (PARTITION BY date)) AS v, "
          "active FROM rk",
    "rs_": "SELECT date, sum(greatest(v * v / 252, 1e-8) * active * active) AS s FROM rv "
           "GROUP BY date",
    "rf": "SELECT date, sum(b * b) * 1e-4 AS f FROM rl GROUP BY date",
    "rc": "SELECT a.date, sum(a.b * b.b * (CASE WHEN a.factor = b.factor THEN 2e-4 ELSE 5e-5 END)"
          ") AS f FROM rl a JOIN rl b USING (date) GROUP BY a.date",
}


def _scaled(df):
    return exposures(df).withColumn("volatility", F.col("volatility") / 1e5)


@query("i13_structured_risk", sql("""
SELECT date, round(f + s, 9) AS variance, round(sqrt((f + s) * 252), 6) AS tracking_error
FROM rf JOIN rs_ USING (date)""", _RISK))
def _(spark, folder):
    df = panel(spark, folder)
    held = I.normalize_benchmark(given_weights(df))
    risk = I.structured_risk(held, _scaled(df), RISK_STYLES)
    return risk.select("date", F.round("variance", 9).alias("variance"),
                       F.round("tracking_error", 6).alias("tracking_error"))


@query("i13_factor_covariance", sql("""
SELECT date, round(f + s, 9) AS variance, round(sqrt((f + s) * 252), 6) AS tracking_error
FROM rc JOIN rs_ USING (date)""", _RISK))
def _(spark, folder):
    df = panel(spark, folder)
    held = I.normalize_benchmark(given_weights(df))
    names = df.select(F.concat(F.lit("industry_"), "industry").alias("f")).distinct().union(
        spark.range(1).select(F.explode(F.array(*map(F.lit, RISK_STYLES)))))
    names = settle(names)  # one row per risk factor
    cov = names.withColumnRenamed("f", "f1").crossJoin(names.withColumnRenamed("f", "f2")).select(
        "f1", "f2", F.when(F.col("f1") == F.col("f2"), 2e-4).otherwise(5e-5).alias("cov"))
    risk = I.structured_risk(held, _scaled(df), RISK_STYLES, factor_cov=cov)
    return risk.select("date", F.round("variance", 9).alias("variance"),
                       F.round("tracking_error", 6).alias("tracking_error"))


LIMITS = {"max_weight": 0.02, "max_active_weight": 0.005, "max_industry_active": 0.02,
          "style_bounds": {"log_mktcap": 0.2, "beta": 0.2}, "max_tracking_error": 0.05,
          "max_turnover": 0.3, "adv_participation": 0.05, "portfolio_value": 1e8}
_AUDIT = {**_RISK, **_turnover_of("gw", "g_")}
_RULES = {
    "budget": ("SELECT date, abs(sum(weight) - 1) AS value FROM ga GROUP BY date", 0.0),
    "non_negative": ("SELECT date, max(greatest(-weight, 0)) AS value FROM ga GROUP BY date", 0.0),
    "max_weight": ("SELECT date, max(weight) AS value FROM ga GROUP BY date", 0.02),
    "max_active_weight": ("SELECT date, max(abs(active)) AS value FROM ga GROUP BY date", 0.005),
    "capacity": ("SELECT date, max(1e8 * weight - 0.05 * adv) AS value FROM ga GROUP BY date",
                 0.0),
    "industry_active": ("SELECT date, max(abs(a)) AS value FROM (SELECT date, industry, "
                        "sum(active) AS a FROM ga GROUP BY date, industry) GROUP BY date", 0.02),
    "style_log_mktcap": ("SELECT date, abs(sum(coalesce(log_mktcap, 0) * active)) AS value FROM "
                         "ga GROUP BY date", 0.2),
    "style_beta": ("SELECT date, abs(sum(coalesce(beta, 0) * active)) AS value FROM ga "
                   "GROUP BY date", 0.2),
    "tracking_error": ("SELECT date, sqrt((f + s) * 252) AS value FROM rf JOIN rs_ USING (date)",
                       0.05),
    "turnover": ("SELECT date, turnover AS value FROM g_h WHERE date > (SELECT min(date) FROM "
                 "g_h)", 0.3),
}


@query("i14_constraint_audit", sql(" UNION ALL ".join(
    f"SELECT date, '{name}' AS \"constraint\", round(value, 4) AS value, CAST({limit} AS DOUBLE) "
    f"AS \"limit\", CAST(value <= {limit} + 1e-9 AS INTEGER) AS ok FROM ({text})"
    for name, (text, limit) in _RULES.items()), _AUDIT))
def _(spark, folder):
    df = panel(spark, folder)
    out = I.constraint_audit(given_weights(df), _scaled(df), LIMITS, RISK_STYLES)
    return out.withColumn("value", F.round("value", 4) + F.lit(0.0))
