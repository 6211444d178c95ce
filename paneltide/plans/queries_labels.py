"""Queries over forward-looking targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import labels as C
from paneltide.plans import panels as P
from paneltide.plans.catalog import query, tidy
from paneltide.plans.oracle import bucket, clip, ols, pct, rounded, sql, zscore
from paneltide.session import settle

KEY = ["date", "stock_id"]


def panel(spark, folder):
    """Labels need prices, returns, benchmark weights and styles, not the factors."""
    months = P.stored_months(spark, folder).drop(*P.FACTORS, "n_lines", "adv")
    return settle(P.with_benchmark(P.with_returns(months)))


def _raw(h: int) -> str:
    return f"lead(close, {h}) OVER (PARTITION BY stock_id ORDER BY date) / close - 1 AS y_raw_{h}"


def _steps(h: int) -> dict[str, str]:
    """Tables of one horizon: raw, benchmark, all four targets, clipped ones."""
    four = [f"y_{k}_{h}" for k in ("raw", "excess", "ind_neutral", "residual")]
    ahead = f"(ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return {
        f"raw_{h}": f"SELECT *, {_raw(h)} FROM panel_rb",
        "bench_day": "SELECT date, coalesce(sum(return * benchmark_weight), 0) / "
                     "sum(benchmark_weight) AS r FROM panel_rb WHERE benchmark_weight > 0 "
                     "GROUP BY date",
        f"bench_{h}": f"SELECT date, CASE WHEN count(r) OVER {ahead} = {h} THEN "
                      f"exp(sum(ln(1 + r)) OVER {ahead}) - 1 END AS bench_fwd_{h} "
                      "FROM bench_day",
        f"two_{h}": f"SELECT r.*, y_raw_{h} - bench_fwd_{h} AS y_excess_{h}, y_raw_{h} - "
                    f"median(y_raw_{h}) OVER (PARTITION BY date, industry) AS y_ind_neutral_{h} "
                    f"FROM raw_{h} r LEFT JOIN bench_{h} USING (date)",
        f"four_{h}": ols(f"two_{h}", f"y_raw_{h}", f"y_residual_{h}"),
        f"clip_{h}": "SELECT date, stock_id, "
                     + ", ".join(f"{clip(c, 'date')} AS {c}" for c in four) + f" FROM four_{h}",
    }


_ONE, _FIVE = _steps(1), _steps(5)
_BOTH = {**_ONE, **_FIVE}


@query("c1_forward_return", sql(f"""
SELECT date, stock_id, {rounded('y_raw_1', 'y_raw_5')} FROM
(SELECT date, stock_id, {_raw(1)}, {_raw(5)} FROM panel)"""))
def _(spark, folder):
    df = P.stored_months(spark, folder).select(*KEY, "close")
    return tidy(C.forward_return(C.forward_return(df, 1), 5).drop("close"))


# A user's day may be worth 0, which has no return (DuckDB would give an infinite one). Ties of the
# last digit are rounded as Spark does, away from 0 by the shortest decimal digits of the double.
@query("c1_forward_return_gaps", sql("""
SELECT date, stock_id,
  CAST(round(CAST(CAST(y AS VARCHAR) AS DECIMAL(38, 24)), 6) AS DOUBLE) AS y_raw_3 FROM
(SELECT date, stock_id, lead(close, 3) OVER (PARTITION BY stock_id ORDER BY date)
  / nullif(close, 0) - 1 AS y FROM user_day)"""))
def _(spark, folder):
    df = settle(P.user_days(spark, folder)).select(*KEY, "close")
    return tidy(C.forward_return(df, 3).drop("close"))


@query("c2_benchmark_return", sql(f"""
SELECT date, {rounded('bench_fwd_5')} FROM bench_5""", _FIVE))
def _(spark, folder):
    return tidy(C.benchmark_forward_return(panel(spark, folder), 5))


@query("c3_excess_return", sql(f"""
SELECT date, stock_id, {rounded('y_excess_5')} FROM two_5""", _FIVE))
def _(spark, folder):
    df = C.forward_return(panel(spark, folder), 5)
    return tidy(C.excess_return(df, 5).select(*KEY, "y_excess_5"))


@query("c4_industry_neutral", sql(f"""
SELECT date, stock_id, {rounded('y_ind_neutral_1')} FROM two_1""", _ONE))
def _(spark, folder):
    df = C.forward_return(panel(spark, folder), 1)
    return tidy(C.industry_neutral_return(df, 1).select(*KEY, "y_ind_neutral_1"))


@query("c5_residual", sql(f"""
SELECT date, stock_id, {rounded('y_residual_1')} FROM four_1""", _ONE))
def _(spark, folder):
    df = C.forward_return(panel(spark, folder), 1)
    return tidy(C.residual_return(df, 1, P.STYLES).select(*KEY, "y_residual_1"))


@query("c6_rank_label", sql(f"""
SELECT date, stock_id, round({pct('y_raw_1', 'date')}, 6) AS y_rank_1 FROM raw_1""", _ONE))
def _(spark, folder):
    df = C.forward_return(panel(spark, folder), 1).select(*KEY, "y_raw_1")
    return tidy(C.rank_labels(df, 1, kinds=("rank",)).drop("y_raw_1"))


@query("c7_group_label", sql(f"""
SELECT date, stock_id, {bucket('y_raw_1', 'date', 5)} AS y_group_1 FROM raw_1""", _ONE))
def _(spark, folder):
    df = C.forward_return(panel(spark, folder), 1).select(*KEY, "y_raw_1")
    return C.rank_labels(df, 1, kinds=("group",)).drop("y_raw_1")


_CLASS = """CASE WHEN {y} IS NULL THEN NULL WHEN {p} >= 0.8 THEN 1 WHEN {p} <= 0.2 THEN 0
  ELSE 2 END"""


@query("c8_class_label", sql(f"""
SELECT date, stock_id, CAST({_CLASS.format(y='y_raw_1', p='p')} AS INTEGER) AS y_class_1
FROM (SELECT *, {pct('y_raw_1', 'date')} AS p FROM raw_1)""", _ONE))
def _(spark, folder):
    df = C.forward_return(panel(spark, folder), 1).select(*KEY, "y_raw_1")
    return C.rank_labels(df, 1, kinds=("class",)).drop("y_raw_1")


@query("c9_winsorize_label", sql(f"""
SELECT date, stock_id, round({clip('y_raw_1', 'date', 0.05, 0.95)}, 6) AS y_raw_1
FROM raw_1""", _ONE))
def _(spark, folder):
    df = C.forward_return(panel(spark, folder), 1).select(*KEY, "y_raw_1")
    return tidy(C.winsorize_labels(df, ["y_raw_1"], 0.05, 0.95))


@query("c10_standardize_label", sql(f"""
SELECT date, stock_id, round({zscore('y_raw_1', 'date', 'NULL')}, 6) AS y_raw_1
FROM raw_1""", _ONE))
def _(spark, folder):
    df = C.forward_return(panel(spark, folder), 1).select(*KEY, "y_raw_1")
    return tidy(C.standardize_labels(df, ["y_raw_1"]))


def _quality(label: str, table: str) -> str:
    return f"""SELECT '{label}' AS label, round(count({label}) / count(*), 6) AS coverage,
  round(avg({label}), 6) AS mean, round(stddev_samp({label}), 6) AS std,
  round(count(*) FILTER (WHERE abs({label} - m) > 3 * s) / count({label}), 6) AS extreme_ratio
FROM {table}, (SELECT avg({label}) AS m, stddev_samp({label}) AS s FROM {table})"""


@query("c11_label_quality", sql(
    f"{_quality('y_raw_1', 'raw_1')} UNION ALL {_quality('y_raw_5', 'raw_5')}", _BOTH))
def _(spark, folder):
    df = C.forward_return(C.forward_return(panel(spark, folder), 1), 5)
    return tidy(C.label_quality(df, ["y_raw_1", "y_raw_5"]))


_HORIZONS = (1, 5, 10, 20)
_ALL = {f"lab_{h}": f"""SELECT *, {pct(f'y_raw_{h}', 'date')} AS y_rank_{h},
  {bucket(f'y_raw_{h}', 'date', 5)} AS y_group_{h} FROM clip_{h}""" for h in _HORIZONS}
_ALL |= {name: text for h in _HORIZONS for name, text in _steps(h).items()}
_FIVES = [f"y_{k}_{h}" for h in _HORIZONS for k in ("raw", "excess", "ind_neutral", "residual", "rank")]


@query("c12_all_labels", sql(f"""
SELECT date, stock_id, {rounded(*_FIVES)}, """ + ", ".join(
    f"y_group_{h}, CAST({_CLASS.format(y=f'y_raw_{h}', p=f'y_rank_{h}')} AS INTEGER) AS y_class_{h}"
    for h in _HORIZONS) + " FROM lab_1 " + " ".join(
        f"JOIN lab_{h} USING (date, stock_id)" for h in _HORIZONS[1:]), _ALL))
def _(spark, folder):
    return tidy(C.build_labels(panel(spark, folder), {}))


@query("c13_group_sizes", sql("""
SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS group_id, n_rows
FROM (SELECT date, count(*) AS n_rows FROM panel GROUP BY date)"""))
def _(spark, folder):
    return C.group_sizes(P.supplier_months(spark, folder))


@query("c14_label_hygiene", sql(f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE g IS NULL) AS n_null,
  0 AS n_negative, 0 AS n_fractional
FROM (SELECT {bucket('y_raw_5', 'date', 5)} AS g, y_raw_5 FROM raw_5)
WHERE y_raw_5 IS NOT NULL""", _FIVE))
def _(spark, folder):
    df = C.forward_return(panel(spark, folder), 5).select(*KEY, "y_raw_5")
    labelled = C.drop_unlabelled(C.rank_labels(df, 5, kinds=("group",)), "y_group_5")
    return C.relevance_violations(C.relevance(labelled, "y_group_5"), "y_group_5")
