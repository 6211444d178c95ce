"""Queries over sources, sinks, cleaning and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import preprocess as B
from paneltide.operators import splits as D
from paneltide.plans import panels as P
from paneltide.plans.catalog import query, tidy
from paneltide.plans.oracle import clip, ols, rounded, sql, zscore
from paneltide.session import scratch_path, settle, stored
from paneltide.sources import panel_store as A
from paneltide.sources import reports
from paneltide.sources import signal_store as S

FACTORS = P.FACTORS
KEY = ["date", "stock_id"]


def panel(spark, folder):
    return P.stored_months(spark, folder)


@query("a1_scan_range", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'""")
def _(spark, folder):
    return A.scan_panel(spark, f"{folder}/orders.parquet", "1996-01-01", "1997-12-31",
                        ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderdate")


@query("a2_cross_section", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE CAST(l_shipdate AS DATE) = DATE '1998-03-05'""")
def _(spark, folder):
    return A.cross_section(spark, f"{folder}/lineitem.parquet", "1998-03-05",
                           ["l_orderkey", "l_linenumber", "l_extendedprice"], "l_shipdate")


@query("a3_calendar", """
SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS day_no
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)""")
def _(spark, folder):
    return A.calendar(P.table(spark, folder, "lineitem"), "l_shipdate")


@query("a4_coverage", sql(f"""
SELECT date, count(*) AS n_rows, count(DISTINCT stock_id) AS n_entities,
  round(({' + '.join(f'avg(CAST({c} IS NULL AS INTEGER))' for c in FACTORS)}) / 4, 6)
    AS null_share,
  count(*) FILTER (WHERE is_st = 0 AND is_suspended = 0) AS n_kept
FROM panel GROUP BY date"""))
def _(spark, folder):
    df = panel(spark, folder)
    kept = B.tradable_universe(df, {"drop_st": True, "drop_suspended": True})
    return tidy(A.coverage_profile(df, kept))


@query("a5_enforce_types", sql(f"""
SELECT date, stock_id, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 6) AS {c}'
                                  for c in FACTORS)} FROM panel"""))
def _(spark, folder):
    df = P.supplier_months(spark, folder).withColumn("date", F.col("date").cast("string"))
    return tidy(A.enforce_types(df, FACTORS).select(*KEY, *FACTORS))


@query("a6_upsert_by_year", sql("""
SELECT * FROM batch UNION ALL
SELECT date, stock_id, close, volume, NULL AS n_lines FROM panel
WHERE (date, stock_id) NOT IN (SELECT (date, stock_id) FROM batch)""", {"batch": """
SELECT date, stock_id, close, volume * 2 AS volume, n_lines FROM panel
WHERE date >= DATE '1998-06-01' AND is_st = 0
UNION ALL SELECT date, 'n' || stock_id, close, volume, n_lines FROM panel WHERE is_st = 1"""}))
def _(spark, folder):
    df = panel(spark, folder)
    root = scratch_path(spark, "panel")
    A.write_by_year(df.select(*KEY, "close", "volume"), root)
    columns = [*KEY, "close", "volume", "n_lines"]
    late = df.filter("date >= '1998-06-01' AND is_st = 0").withColumn("volume", F.col("volume") * 2)
    new = df.filter("is_st = 1").withColumn("stock_id", F.concat(F.lit("n"), "stock_id"))
    A.write_by_year(late.unionByName(new).select(*columns), root)
    return A.scan_panel(spark, root, merge_schema=True).select(*columns)


def _metadata(spark, name="gbt_reg_excess_h1_v01", family="lightgbm"):
    return spark.range(1).select(
        F.lit(family).alias("model_family"), F.lit(name).alias("model_name"),
        *(F.lit(v).alias(k) for k, v in {
            "model_version": "v01", "feature_version": "f01", "label_version": "l01",
            "label_type": "excess_return", "horizon": 1, "objective_type": "regression",
            "window_id": "w000_19980101", "train_start": "1995-01-01", "train_end": "1996-12-31",
            "valid_start": "1997-01-01", "valid_end": "1997-12-31", "test_start": "1998-01-01",
            "test_end": "2001-12-31", "ic_valid": 0.02, "rankic_valid": 0.03, "icir_valid": 0.2,
            "best_iteration": 7}.items()))


def _store_rows(spark, folder):
    df = panel(spark, folder)
    out = None
    for name, (family, source) in P.MODELS.items():
        rows = S.signal_frame(df.select(*KEY, F.col(source).alias("raw_score")),
                              _metadata(spark, name, family))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("a7_signal_store", sql("""
SELECT date, stock_id, model_family, model_name, model_version, horizon, raw_score FROM signals
WHERE model_name = 'rf_reg_excess_h1_v01'
  AND date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30'"""))
def _(spark, folder):
    root = scratch_path(spark, "signals")
    S.write_signals(_store_rows(spark, folder), root)
    return S.read_signals(spark, root, "rf_reg_excess_h1_v01", "1997-01-01", "1999-06-30",
                          [*KEY, "model_family", "model_name", "model_version", "horizon",
                           "raw_score"])


_DAMAGED = {"damaged": """
SELECT date, stock_id, CASE WHEN month(date) = 1 THEN 'other' ELSE model_family END
  AS model_family, model_name, CASE WHEN stock_id LIKE '%7' THEN '' ELSE model_version END
  AS model_version, CASE WHEN stock_id LIKE '%3' THEN 7 ELSE horizon END AS horizon,
  label_type, CASE WHEN month(date) = 2 THEN NULL WHEN stock_id LIKE '%9' THEN 'survival'
  ELSE objective_type END AS objective_type,
  CASE WHEN month(date) = 3 THEN NULL ELSE feature_version END AS feature_version,
  CASE WHEN stock_id LIKE '%1' AND month(date) > 6 THEN '' ELSE label_version END AS label_version
FROM versioned
UNION ALL SELECT date, stock_id, model_family, model_name, model_version, horizon,
  NULL, objective_type, feature_version, label_version FROM versioned
  WHERE month(date) = 5 AND stock_id NOT LIKE '%7'""",
            "versioned": "SELECT *, 'f01' AS feature_version, 'l01' AS label_version FROM signals"}


def _empty_count(column: str) -> str:
    return f"SELECT 'empty_{column}' AS rule, count(*) FILTER (WHERE coalesce({column}, '') = '') AS n_bad FROM damaged"


def _outside_count(column: str, allowed: list) -> str:
    names = ", ".join(repr(a) for a in allowed)
    return (f"SELECT 'bad_{column}', count(*) FILTER (WHERE {column} IS NULL OR {column} NOT IN ({names})) "
            "FROM damaged")


@query("a8_signal_contract", sql(" UNION ALL ".join([
    *(_empty_count(c) for c in S.VERSIONS), _outside_count("model_family", S.FAMILIES),
    _outside_count("objective_type", S.OBJECTIVES), _outside_count("label_type", S.LABEL_TYPES),
    _outside_count("horizon", S.HORIZONS),
    """SELECT 'duplicate_key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM
  (SELECT count(*) AS n FROM damaged GROUP BY date, stock_id, model_name, model_version)"""]), _DAMAGED))
def _(spark, folder):
    good = settle(_store_rows(spark, folder))
    month, stock = F.month("date"), F.col("stock_id")
    bad = good.withColumns({
        "model_family": F.when(month == 1, "other").otherwise(F.col("model_family")),
        "model_version": F.when(stock.like("%7"), "").otherwise(F.col("model_version")),
        "horizon": F.when(stock.like("%3"), 7).otherwise(F.col("horizon")),
        "objective_type": F.when(month == 2, F.lit(None)).when(stock.like("%9"), "survival")
        .otherwise(F.col("objective_type")),
        "feature_version": F.when(month != 3, F.col("feature_version")),
        "label_version": F.when(stock.like("%1") & (month > 6), "").otherwise(F.col("label_version"))})
    again = good.filter((month == 5) & ~stock.like("%7")).withColumn("label_type", F.lit(None).cast("string"))
    return S.contract_violations(bad.unionByName(again))


@query("a9_signal_frame", sql("""
SELECT date, stock_id, 'lightgbm' AS model_family, 'gbt_reg_excess_h1_v01' AS model_name,
  'v01' AS model_version, 'f01' AS feature_version, 'l01' AS label_version,
  'excess_return' AS label_type, CAST(1 AS INTEGER) AS horizon,
  'regression' AS objective_type, factor_001 AS raw_score, 'w000_19980101' AS window_id,
  DATE '1995-01-01' AS train_start, DATE '1996-12-31' AS train_end,
  DATE '1997-01-01' AS valid_start, DATE '1997-12-31' AS valid_end,
  DATE '1998-01-01' AS test_start, DATE '2001-12-31' AS test_end,
  CAST(0.02 AS DOUBLE) AS ic_valid, CAST(0.03 AS DOUBLE) AS rankic_valid,
  CAST(0.2 AS DOUBLE) AS icir_valid, CAST(7 AS INTEGER) AS best_iteration FROM panel"""))
def _(spark, folder):
    predictions = P.supplier_months(spark, folder).select(
        *KEY, F.col("factor_001").alias("raw_score"))
    return S.signal_frame(predictions, _metadata(spark)).drop("created_time")


@query("a10_report_sinks", sql("""
SELECT date, count(*) AS n_rows, round(avg(factor_001), 6) AS mean_score
FROM panel GROUP BY date"""))
def _(spark, folder):
    daily = P.supplier_months(spark, folder).groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("factor_001").alias("mean_score"))
    root = scratch_path(spark, "reports")
    table = settle(tidy(daily))
    paths = reports.save_tables({"daily": table, "daily_csv": table}, root, csv=("daily_csv",))
    return spark.read.csv(paths[1], header=True, schema=table.schema)


@query("b1_universe", sql("""
SELECT date, stock_id FROM panel WHERE is_st = 0 AND is_suspended = 0"""))
def _(spark, folder):
    return B.tradable_universe(P.supplier_months(spark, folder),
                               {"drop_st": True, "drop_suspended": True}).select(*KEY)


@query("b2_missing_rate", sql(" UNION ALL ".join(
    f"SELECT date, '{c}' AS factor, round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS missing_rate "
    "FROM panel GROUP BY date" for c in FACTORS)))
def _(spark, folder):
    return tidy(B.missing_rates(P.supplier_months(spark, folder), FACTORS))


@query("b3_valid_factors", sql("""
SELECT factor, round(missing_rate, 6) AS missing_rate FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS factor, avg(CAST({c} IS NULL AS INTEGER)) AS missing_rate FROM panel "
        "WHERE date = (SELECT min(date) FROM panel)" for c in FACTORS)
    + ") WHERE missing_rate <= 0.005"))
def _(spark, folder):
    return tidy(B.valid_factors(panel(spark, folder), FACTORS, 0.005))


@query("b4_winsorize", sql(f"""
SELECT date, stock_id, {', '.join(f'round({clip(c, "date", 0.05, 0.95)}, 6) AS {c}'
                                  for c in FACTORS)} FROM panel"""))
def _(spark, folder):
    return tidy(B.winsorize(panel(spark, folder), ["date"], FACTORS, 0.05, 0.95)
                .select(*KEY, *FACTORS))


def _filled(method):
    medians = {"median": "median({0}) OVER (PARTITION BY date)",
               "industry_median": "median({0}) OVER (PARTITION BY date, industry), "
                                  "median({0}) OVER (PARTITION BY date)", "zero": "0"}[method]
    columns = ", ".join(f"round(coalesce({c}, {medians.format(c)}), 6) AS {c}" for c in FACTORS)
    return sql(f"SELECT date, stock_id, {columns} FROM panel")


def _fill(method):
    def run(spark, folder):
        return tidy(B.fill_missing(panel(spark, folder), FACTORS, method).select(*KEY, *FACTORS))
    return run


for _method in B.FILL_METHODS:
    query(f"b5_fill_{_method}", _filled(_method))(_fill(_method))


@query("b6_standardize", sql(f"""
SELECT date, stock_id, {', '.join(f'round({zscore(c, "date")}, 6) AS {c}' for c in FACTORS)}
FROM panel"""))
def _(spark, folder):
    return tidy(B.standardize(panel(spark, folder), ["date"], FACTORS).select(*KEY, *FACTORS))


@query("b6_standardize_by_industry", sql(f"""
SELECT date, stock_id, {', '.join(f'round({zscore(c, "date, industry")}, 6) AS {c}'
                                  for c in FACTORS)} FROM panel"""))
def _(spark, folder):
    return tidy(B.standardize(panel(spark, folder), ["date", "industry"], FACTORS)
                .select(*KEY, *FACTORS))


@query("b7_neutralize", sql(f"""
SELECT date, stock_id, {rounded(*FACTORS)} FROM n4""", {
    f"n{i + 1}": ols(f"n{i}" if i else "panel", c, "") for i, c in enumerate(FACTORS)}))
def _(spark, folder):
    return tidy(B.neutralize(panel(spark, folder), FACTORS, P.STYLES).select(*KEY, *FACTORS))


CLEANING = {"filter": {"drop_st": True, "drop_suspended": True},
            "neutralize": {"enabled": True, "neutral_cols": P.STYLES}}


def _each(template: str, names=FACTORS) -> str:
    return ", ".join(f"{template.format(c=c)} AS {c}" for c in names)


_CLEAN = {
    "c0": "SELECT * FROM panel WHERE is_st = 0 AND is_suspended = 0",
    "c1": "SELECT * REPLACE (" + ", ".join(f"{clip(c, 'date')} AS {c}" for c in FACTORS)
          + ") FROM c0",
    "c2": f"SELECT * REPLACE ({_each('coalesce({c}, median({c}) OVER (PARTITION BY date))')})"
          " FROM c1",
    "c3": "SELECT * REPLACE (" + ", ".join(f"{zscore(c, 'date')} AS {c}" for c in FACTORS)
          + ") FROM c2",
    **{f"c{4 + i}": ols(f"c{3 + i}", c, "") for i, c in enumerate(FACTORS)},
}


@query("b8_preprocess", sql(f"SELECT date, stock_id, {rounded(*FACTORS)} FROM c7", _CLEAN))
def _(spark, folder):
    out = B.preprocess(panel(spark, folder), FACTORS, CLEANING, float32=False)
    return tidy(out.select(*KEY, *FACTORS))


@query("b8_preprocess_dataset", sql(f"""
SELECT date, stock_id, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4) AS {c}' for c in FACTORS)}
FROM c7""", _CLEAN))
def _(spark, folder):
    source, target = scratch_path(spark, "raw"), scratch_path(spark, "clean")
    A.write_by_year(P.supplier_months(spark, folder), source, overwrite=True)
    B.preprocess_dataset(spark, source, target, CLEANING)
    return tidy(A.scan_panel(spark, target).select(*KEY, *FACTORS), 4)


WIDE = 300


def wide_panel(spark, folder):
    """The supplier panel with ``WIDE`` factors, each a mix of two of the four."""
    df = panel(spark, folder)
    names = [f"factor_{i:03d}" for i in range(1, WIDE + 1)]
    mixes = [(F.col(FACTORS[i % 4]) * F.lit(1 + i % 7 / 8) + F.col(FACTORS[i // 4 % 4]) * F.lit(i % 5 / 4)).alias(name)
             for i, name in enumerate(names, 1)]
    keep = [c for c in df.columns if c not in FACTORS]
    return stored(df.select(*keep, *mixes), "wide"), names


def _pick(at: str) -> str:
    return "CASE " + " ".join(f"WHEN {at} = {k} THEN {c}" for k, c in enumerate(FACTORS)) + " END"


_PART = "date, factor"
_WIDE = {
    **_CLEAN,
    "w0": f"SELECT date, stock_id, industry, {', '.join(P.STYLES)}, i AS factor, {_pick('i % 4')} * (1 + CAST(i % 7 AS DOUBLE) / 8)"
          f" + {_pick('i // 4 % 4')} * (CAST(i % 5 AS DOUBLE) / 4) AS v FROM c0, range(1, {WIDE + 1}) AS r(i)",
    "w1": f"SELECT * REPLACE ({clip('v', _PART)} AS v) FROM w0",
    "w2": f"SELECT * REPLACE (coalesce(v, median(v) OVER (PARTITION BY {_PART})) AS v) FROM w1",
    "w3": f"SELECT * REPLACE ({zscore('v', _PART)} AS v) FROM w2",
    "w4": ols("w3", "v", "", _PART),
}


@query("b8_preprocess_wide", sql("""
SELECT date, printf('factor_%03d', factor) AS factor, count(v) AS n_values, round(max(v), 5) AS high,
  round(min(v), 5) AS low, round(avg(abs(v)), 5) AS spread FROM w4 GROUP BY date, factor""", _WIDE))
def _(spark, folder):
    df, names = wide_panel(spark, folder)
    out = B.preprocess(df, names, CLEANING, float32=False)
    cells = out.select("date", F.posexplode(F.array(*names)).alias("place", "v"))
    found = cells.groupBy("date", "place").agg(
        F.count("v").alias("n_values"), F.max("v").alias("high"), F.min("v").alias("low"),
        F.avg(F.abs("v")).alias("spread"))
    name = F.get(F.array(*map(F.lit, names)), F.col("place")).alias("factor")
    return tidy(found.select("date", name, "n_values", "high", "low", "spread"), 5)


ROLLING = {"train_years": 2, "valid_years": 1, "test_months": 3, "step_months": 3}
SPAN = ("1995-01-01", "2001-11-30")
_STEPS = "(SELECT unnest(generate_series(0, 40)) AS n)"


def _windows_sql(prefix: str, train: str, valid: str) -> str:
    return f"""
SELECT printf('{prefix}%03d_%s', n, strftime(test_start, '%Y%m%d')) AS window_id,
  CAST(train_start AS DATE) AS train_start, CAST(valid_start - INTERVAL 1 DAY AS DATE)
  AS train_end, CAST(valid_start AS DATE) AS valid_start,
  CAST(test_start - INTERVAL 1 DAY AS DATE) AS valid_end, CAST(test_start AS DATE) AS test_start,
  CAST(least(test_start + INTERVAL 3 MONTH - INTERVAL 1 DAY, DATE '{SPAN[1]}') AS DATE)
  AS test_end
FROM (SELECT n, {train} AS train_start, {valid} AS valid_start,
  {valid} + INTERVAL 1 YEAR AS test_start FROM {_STEPS})
WHERE test_start <= DATE '{SPAN[1]}'"""


_ROLL = _windows_sql("w", f"DATE '{SPAN[0]}' + INTERVAL (3 * n) MONTH",
                     f"DATE '{SPAN[0]}' + INTERVAL (3 * n + 24) MONTH")
_GROW = _windows_sql("e", f"DATE '{SPAN[0]}'", f"DATE '{SPAN[0]}' + INTERVAL (3 * n + 36) MONTH")


def shipping_days(spark, folder):
    """Stored calendar of the data's own span: from the first day of its first month to the last of its last."""
    ends = P.table(spark, folder, "lineitem").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return stored(ends.select(F.explode(F.array(F.trunc("a", "month"), F.last_day("b"))).alias("date")), "span")


def _anchored(spark, folder, make, **options):
    """Windows over the span of the data's own shipping months."""
    return make(spark, shipping_days(spark, folder), **options)


_BOUNDS = {
    "bounds": "SELECT CAST(date_trunc('month', min(l_shipdate)) AS DATE) AS a, "
              "CAST(last_day(max(l_shipdate)) AS DATE) AS b FROM lineitem",
}


def _bounded(text: str) -> str:
    """Use the data's own span instead of fixed dates."""
    return (text.replace(f"DATE '{SPAN[0]}'", "(SELECT a FROM bounds)")
            .replace(f"DATE '{SPAN[1]}'", "(SELECT b FROM bounds)"))


_SPLIT = {
    **_BOUNDS,
    "win": _bounded(_ROLL),
    "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_no "
           "FROM (SELECT DISTINCT date FROM panel)",
    "ins": "SELECT * FROM cal JOIN win ON date BETWEEN train_start AND test_end",
    "cut": "SELECT window_id, max(day_no) FILTER (WHERE date <= train_end) AS t, "
           "max(day_no) FILTER (WHERE date <= valid_end) AS v FROM ins GROUP BY window_id",
    "spl": "SELECT date, window_id, CASE WHEN date <= train_end AND day_no <= t - 1 "
           "THEN 'train' WHEN date BETWEEN valid_start AND valid_end AND day_no <= v - 1 "
           "THEN 'valid' WHEN date >= test_start THEN 'test' END AS split "
           "FROM ins JOIN cut USING (window_id)",
    "wrows": "SELECT window_id, split, date, stock_id FROM spl JOIN panel USING (date) "
             "WHERE split IS NOT NULL",
    "gin": "SELECT * FROM cal JOIN grow ON date BETWEEN train_start AND test_end",
    "grow": _bounded(_GROW),
}


def _sized(win: str, ins: str) -> str:
    """Windows with the days and rows of their splits, without an embargo."""
    cells = ", ".join(f"coalesce(count(*) FILTER (WHERE s = '{s}'), 0) AS {s}_days, "
                      f"CAST(coalesce(sum(n) FILTER (WHERE s = '{s}'), 0) AS BIGINT) AS {s}_rows"
                      for s in ("train", "valid", "test"))
    return (f"SELECT w.*, c.* EXCLUDE (window_id) FROM {win} w JOIN (SELECT window_id, {cells} FROM (SELECT *, CASE "
            f"WHEN date <= train_end THEN 'train' WHEN date <= valid_end THEN 'valid' ELSE 'test' END AS s FROM {ins} "
            "JOIN (SELECT date, count(*) AS n FROM panel GROUP BY date) USING (date)) GROUP BY window_id) c USING (window_id)")


def _window_sizes(spark, folder, make, **options):
    df = panel(spark, folder)
    return D.window_sizes(_anchored(spark, folder, make, **options), df, A.calendar(df), 0)


@query("d1_rolling_windows", sql(_sized("win", "ins"), _SPLIT))
def _(spark, folder):
    return _window_sizes(spark, folder, D.rolling_windows, **ROLLING)


@query("d2_expanding_windows", sql(_sized("grow", "gin"), _SPLIT))
def _(spark, folder):
    return _window_sizes(spark, folder, D.expanding_windows, min_train_years=3, valid_years=1,
                         test_months=3, step_months=3)


def _window_rows(spark, folder):
    df = panel(spark, folder)
    windows = _anchored(spark, folder, D.rolling_windows, **ROLLING)
    return D.indexed_rows(windows, df.select(*KEY, *FACTORS), df.select(*KEY, "close"), 1)


@query("d3_window_rows", sql("""
SELECT window_id, split, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
FROM wrows GROUP BY window_id, split""", _SPLIT))
def _(spark, folder):
    return D.rows_by_window(_window_rows(spark, folder)).groupBy("window_id", "split").agg(
        F.sum("n_rows").alias("n_rows"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"))


@query("d4_split_audit", sql("""
SELECT *, CAST(NOT coalesce(train_max < valid_min AND valid_max < test_min, FALSE) AS INTEGER)
  AS leaks FROM (SELECT window_id, max(date) FILTER (WHERE split = 'train') AS train_max,
  min(date) FILTER (WHERE split = 'valid') AS valid_min,
  max(date) FILTER (WHERE split = 'valid') AS valid_max,
  min(date) FILTER (WHERE split = 'test') AS test_min,
  count(*) FILTER (WHERE split = 'train') AS n_train,
  count(*) FILTER (WHERE split = 'valid') AS n_valid,
  count(*) FILTER (WHERE split = 'test') AS n_test FROM wrows GROUP BY window_id)""", _SPLIT))
def _(spark, folder):
    return D.split_audit(_window_rows(spark, folder))
