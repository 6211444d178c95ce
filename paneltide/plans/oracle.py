"""SQL twins of the registered queries, for an independent engine.

``sql(body)`` prepends the shared tables of ``SHARED`` that the body uses.
"""

from __future__ import annotations

import re

from paneltide.plans.panels import MODELS, STYLES

SHARED: dict[str, str] = {}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named tables it needs, in dependency order."""
    tables = {**SHARED, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in tables:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_name(name)

    def visit_name(name: str) -> None:
        text = tables[name]
        for other in tables:
            if other != name and other not in order and re.search(rf"\b{other}\b", text):
                visit_name(other)
        if name not in order:
            order.append(name)

    visit(body)
    head = ",\n".join(f"{n} AS ({tables[n]})" for n in order)
    text = f"WITH {head}\n{body}" if order else body
    # Adding 0 turns a negative zero into a plain one.
    return text.replace("round(", "0.0 + round(")


def rounded(*columns: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c.split('.')[-1]}" for c in columns)


def pct(value: str, part: str) -> str:
    """Average-rank percentile; nulls sort last and stay null."""
    return (f"CASE WHEN {value} IS NOT NULL THEN "
            f"(rank() OVER (PARTITION BY {part} ORDER BY {value})"
            f" + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0 - 1)"
            f" / greatest(count({value}) OVER (PARTITION BY {part}) - 1, 1) END")


def avg_rank(value: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {value})"
            f" + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0)")


def bucket(value: str, part: str, n: int) -> str:
    return (f"CASE WHEN {value} IS NOT NULL THEN CAST("
            f"(row_number() OVER (PARTITION BY {part} ORDER BY {value}, stock_id) - 1) * {n}"
            f" // count({value}) OVER (PARTITION BY {part}) AS INTEGER) END")


def clip(value: str, part: str, low: float = 0.01, high: float = 0.99) -> str:
    q = "quantile_cont({0}, {1}) OVER (PARTITION BY {2})".format
    return (f"CASE WHEN {value} IS NOT NULL THEN least(greatest({value}, "
            f"{q(value, low, part)}), {q(value, high, part)}) END")


def zscore(value: str, part: str, flat: str = "0.0") -> str:
    s = f"stddev_samp({value}) OVER (PARTITION BY {part})"
    return (f"CASE WHEN {s} IS NULL OR {s} = 0 THEN {flat} ELSE "
            f"({value} - avg({value}) OVER (PARTITION BY {part})) / {s} END")


def corr(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def ols(source: str, y: str, out: str, part: str = "date", styles: list[str] = STYLES,
        group: str = "industry") -> str:
    """Residual of y: demean inside groups, then orthogonalize style by style."""
    k = len(styles)
    xs = "".join(f", coalesce({s}, median({s}) OVER (PARTITION BY {part}), 0) AS x{i}"
                 for i, s in enumerate(styles))
    text = (f"SELECT *, {y} AS yy, coalesce({group}, 'UNKNOWN') AS gg{xs} FROM {source}")
    inner = "".join(
        f", CASE WHEN yy IS NOT NULL THEN x{i} - avg(x{i}) FILTER (WHERE yy IS NOT NULL)"
        f" OVER (PARTITION BY {part}, gg) END AS d{i}" for i in range(k))
    text = (f"SELECT * EXCLUDE (yy), yy IS NOT NULL AS used, "
            f"count(yy) OVER (PARTITION BY {part}) AS n_used, "
            f"count(DISTINCT gg) OVER (PARTITION BY {part}) AS n_groups, "
            f"yy - avg(yy) OVER (PARTITION BY {part}, gg) AS yy{inner} FROM ({text})")
    for i in range(k):
        def less(c: str, i: int = i) -> str:
            return (f"{c} - d{i} * sum({c} * d{i}) OVER (PARTITION BY {part})"
                    f" / nullif(sum(d{i} * d{i}) OVER (PARTITION BY {part}), 0) AS {c}")
        names = ["yy", *(f"d{j}" for j in range(i + 1, k))]
        text = f"SELECT * REPLACE ({', '.join(less(c) for c in names)}) FROM ({text})"
    drop = ["yy", "gg", "used", "n_used", "n_groups", *(f"x{i}" for i in range(k)),
            *(f"d{i}" for i in range(k))]
    if out in ("", y):
        return (f"SELECT * EXCLUDE ({', '.join(drop)}) REPLACE (CASE WHEN used AND n_used > "
                f"{k} + n_groups THEN yy END AS {y}) FROM ({text})")
    return (f"SELECT * EXCLUDE ({', '.join(drop)}), CASE WHEN used AND n_used > {k} + n_groups "
            f"THEN yy END AS {out} FROM ({text})")


def drawdown(source: str, ret: str, part: str = "1") -> str:
    """Adds the running fall of the compounded value as ``fall``."""
    frame = f"(PARTITION BY {part} ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return (f"SELECT *, 1 - nav / max(nav) OVER {frame} AS fall FROM (SELECT *, "
            f"product(1 + coalesce({ret}, 0)) OVER {frame} AS nav FROM {source})")


SHARED["panel_base"] = """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey, count(*) AS n_lines,
  sum(l_quantity) AS volume,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS price,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS tax,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS disc,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned,
  CAST(max(CAST(round(l_extendedprice * 100) AS BIGINT)) - min(CAST(round(l_extendedprice * 100) AS BIGINT))
    AS DOUBLE) / 100 AS price_span,
  CAST(max(CAST(round(l_discount * 100) AS BIGINT)) - min(CAST(round(l_discount * 100) AS BIGINT))
    AS DOUBLE) / 100 AS disc_span
FROM lineitem GROUP BY ALL"""
SHARED["panel"] = """
SELECT date, CAST(l_suppkey AS VARCHAR) AS stock_id, r_name AS industry, price / volume AS close,
  volume, volume AS turnover, n_lines, round(ln(price / 100), 4) AS log_mktcap,
  tax / n_lines AS beta, CASE WHEN n_lines > 1 THEN price_span END AS volatility,
  price AS adv, disc / n_lines AS factor_001,
  CASE WHEN n_lines > 1 THEN disc_span END AS factor_002, volume / n_lines AS factor_003,
  CAST(returned AS DOUBLE) / n_lines AS factor_004,
  CAST(n_lines = 1 AS INTEGER) AS is_st, CAST(returned = n_lines AS INTEGER) AS is_suspended
FROM panel_base JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
SHARED["panel_r"] = """SELECT *,
  close / lag(close) OVER (PARTITION BY stock_id ORDER BY date) - 1 AS return FROM panel"""
SHARED["panel_rb"] = """SELECT *, volume / sum(volume) OVER (PARTITION BY date) AS benchmark_weight
FROM panel_r"""
SHARED["future"] = """SELECT date, stock_id, industry,
  lead(close, 1) OVER (PARTITION BY stock_id ORDER BY date) / close - 1 AS future_return_1d
FROM panel"""
SHARED["user_day"] = """SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS stock_id,
  count(*) AS n_events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS close,
  arg_max(event_type, (ts, event_id)) AS industry
FROM events GROUP BY CAST(ts AS DATE), user_id"""
SHARED["signals"] = " UNION ALL ".join(
    f"SELECT date, stock_id, '{family}' AS model_family, '{name}' AS model_name, "
    f"{source} AS raw_score, 'v01' AS model_version, 'excess_return' AS label_type, "
    f"1 AS horizon, 'regression' AS objective_type FROM panel"
    for name, (family, source) in MODELS.items())
_M = "model_name, date"
SHARED["sig_w"] = f"SELECT *, {clip('raw_score', _M)} AS w FROM signals"
SHARED["sig_z"] = (f"SELECT * EXCLUDE (w), {zscore('w', _M)} AS zscore_score, "
                   f"{pct('w', _M)} AS rank_score FROM sig_w")
SHARED["sig_x"] = ("SELECT s.*, p.industry, p.log_mktcap, p.beta, p.turnover, p.volatility "
                   "FROM sig_z s LEFT JOIN panel p USING (date, stock_id)")
SHARED["sig_n1"] = ("SELECT *, zscore_score - avg(zscore_score) OVER "
                    "(PARTITION BY model_name, date, industry) AS n1 FROM sig_x")
SHARED["sig_n2"] = ols("sig_n1", "n1", "n2", _M)
SHARED["processed"] = (
    "SELECT date, stock_id, model_family, model_name, model_version, label_type, horizon, "
    "objective_type, raw_score, rank_score, zscore_score, "
    f"{zscore('n2', _M)} AS neutral_score FROM sig_n2")
