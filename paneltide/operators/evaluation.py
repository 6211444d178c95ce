"""How well a signal orders future returns.

``series`` names the columns that tell signals apart (model, score column);
a cross-section is one date of one series. Per-series windows run over tables
of one row per date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.lookup import attach, join_rows
from paneltide.functions.moments import UNKNOWN_GROUP, pearson, ratio
from paneltide.functions.order import bucket_of, ordinal_rank, pair_ranks
from paneltide.session import settle, stored

PERIODS = 252
# Names of style columns, of score columns and of the dimensions of a comparison.
STYLE_NAMES = ["log_mktcap", "beta", "turnover", "volatility", "liquidity", "value", "growth",
               "quality"]
SCORE_COLUMNS = ["raw_score", "rank_score", "zscore_score", "neutral_score"]
COMPARED = ["model_family", "objective_type", "label_type", "horizon", "score_col"]


def _pairs(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def daily_ic(df: DataFrame, signal: str, ret: str, series: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation per date over complete pairs."""
    return _pairs(df, signal, ret).groupBy(*series, "date").agg(pearson(signal, ret).alias("ic"))


def daily_rank_ic(df: DataFrame, signal: str, ret: str, series: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks per date, ranked after incomplete pairs are dropped."""
    by = [*series, "date"]
    pairs = settle(_pairs(df, signal, ret).select(*by, "stock_id", signal, ret))
    both = pair_ranks(pairs, by, signal, ret, "stock_id")
    return both.groupBy(*by).agg(pearson("_r1", "_r2").alias("rank_ic"))


def daily_results(df: DataFrame, signal: str, ret: str, n_groups: int | None = 5, series: Sequence[str] = ()) -> DataFrame:
    """``ic``, ``rank_ic`` and, with ``n_groups``, ``long_short_ret`` per date, from one ranking pass.

    A date without a complete pair has no row; one without both outer buckets has a null gain.
    """
    by = [*series, "date"]
    pairs = settle(_pairs(df, signal, ret).select(*by, "stock_id", signal, ret))
    ranked = pair_ranks(pairs, by, signal, ret, "stock_id")
    gain = []
    if n_groups:
        ranked = ranked.withColumn("_bucket", bucket_of(n_groups, "_rank", "_n"))
        top, low = (F.avg(F.when(F.col("_bucket") == b, F.col(ret))) for b in (n_groups - 1, 0))
        gain = [(top - low).alias("long_short_ret")]
    return ranked.groupBy(*by).agg(pearson(signal, ret).alias("ic"), pearson("_r1", "_r2").alias("rank_ic"), *gain)


def ic_summary(daily: DataFrame, column: str = "ic", series: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, information ratio, t value and positive share over the dates."""
    mean, std, n = F.avg(column), F.stddev_samp(column), F.count(column)
    icir = F.when(std > 0, ratio(mean, std))
    return daily.groupBy(*series).agg(
        mean.alias("ic_mean"), std.alias("ic_std"), icir.alias("icir"),
        (icir * F.sqrt(n)).alias("ic_tstat"),
        F.avg(F.when(F.col(column).isNotNull(), (F.col(column) > 0).cast("int")))
        .alias("ic_positive_ratio"), n.alias("n_days"))


def with_bucket(df: DataFrame, signal: str, n_groups: int = 5, series: Sequence[str] = (),
                name: str = "bucket") -> DataFrame:
    """Quantile bucket of the date, 0 at the bottom; null scores have none."""
    return (ordinal_rank(df, [*series, "date"], signal, "stock_id")
            .withColumn(name, bucket_of(n_groups)).drop("_rank", "_count"))


def bucket_returns(df: DataFrame, signal: str, ret: str, n_groups: int = 5,
                   series: Sequence[str] = ()) -> DataFrame:
    """Mean return and row count per date and bucket."""
    grouped = with_bucket(_pairs(df, signal, ret).select(*series, "date", "stock_id", signal, ret),
                          signal, n_groups, series)
    return _bucket_means(grouped, ret, series)


def _bucket_means(grouped: DataFrame, ret: str, series: Sequence[str]) -> DataFrame:
    return grouped.groupBy(*series, "date", "bucket").agg(
        F.avg(ret).alias("group_return"), F.count(F.lit(1)).alias("n_stocks"))


def long_short(buckets: DataFrame, n_groups: int = 5, series: Sequence[str] = ()) -> DataFrame:
    """Top less bottom bucket on the dates that have both."""
    def leg(number):
        return F.max(F.when(F.col("bucket") == number, F.col("group_return")))
    return (buckets.groupBy(*series, "date")
            .agg(leg(n_groups - 1).alias("long_ret"), leg(0).alias("short_ret"))
            .filter("long_ret IS NOT NULL AND short_ret IS NOT NULL")
            .withColumn("long_short_ret", F.col("long_ret") - F.col("short_ret")))


def _number_of_buckets(quantile: float) -> int:
    return max(round(1.0 / quantile), 2)


def top_bucket(df: DataFrame, signal: str, quantile: float = 0.2,
               series: Sequence[str] = ()) -> DataFrame:
    n = _number_of_buckets(quantile)
    return with_bucket(_pairs(df, signal), signal, n, series).filter(F.col("bucket") == n - 1)


def top_turnover(df: DataFrame, signal: str, quantile: float = 0.2,
                 series: Sequence[str] = ()) -> DataFrame:
    """Share of the top bucket that was not in it on the previous date."""
    keys = [*series, "date", "stock_id"]
    return turnover_of_sets(top_bucket(df.select(*keys, signal), signal, quantile, series)
                            .select(*keys), series)


def turnover_of_sets(members: DataFrame, series: Sequence[str] = (), sizes: DataFrame | None = None) -> DataFrame:
    """Share of each date's members that were not members on the previous date.

    ``sizes`` (series, date, size) may be given if it is stored already.
    """
    keys = [*series, "date"]
    members = stored(members.select(*keys, "stock_id"), "members")
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")) if sizes is None else sizes
    order = Window.partitionBy(*series, F.lit(0)).orderBy("date")
    dates = stored(sizes.select(*keys, "size", F.row_number().over(order).alias("day_no")), "dates")
    numbered = attach(members, dates.select(*keys, "day_no"), keys, settled=True)
    # An entity's own dates: it stayed if its row before is of the date before.
    before = F.lag("day_no").over(Window.partitionBy(*series, "stock_id").orderBy("day_no"))
    stayed = (numbered.withColumn("_stayed", before == F.col("day_no") - 1)
              .groupBy(*keys).agg(F.count_if("_stayed").alias("stay")))
    return (dates.filter("day_no > 1").join(stayed, keys, "left")
            .select(*keys, (1 - F.coalesce("stay", F.lit(0)) / F.col("size")).alias("turnover")))


def _nav(ret: str, series: Sequence[str]) -> tuple[Column, Column]:
    so_far = (Window.partitionBy(*series, F.lit(0)).orderBy("date")
              .rowsBetween(Window.unboundedPreceding, 0))
    return F.product(1 + F.coalesce(ret, F.lit(0.0))).over(so_far), F.max("_nav").over(so_far)


def drawdown(daily: DataFrame, ret: str, series: Sequence[str] = (),
             name: str = "max_drawdown") -> DataFrame:
    """Largest fall of the compounded value below its running high."""
    nav, high = _nav(ret, series)
    falls = daily.withColumn("_nav", nav).withColumn("_high", high)
    return falls.groupBy(*series).agg(F.max(1 - ratio(F.col("_nav"), F.col("_high"))).alias(name))


def annualize(daily: DataFrame, ret: str, series: Sequence[str] = (),
              periods: int = PERIODS) -> DataFrame:
    """Annual return, volatility, Sharpe ratio, drawdown and win rate; one row per series."""
    valid = daily.filter(F.col(ret).isNotNull())
    mean, std = F.avg(ret) * periods, F.stddev_samp(ret) * F.sqrt(F.lit(float(periods)))
    stats = valid.groupBy(*series).agg(
        mean.alias("ann_return"), std.alias("ann_vol"),
        F.when(std > 0, ratio(mean, std)).alias("sharpe"),
        F.avg((F.col(ret) > 0).cast("int")).alias("win_rate"))
    return _side_by_side(stats, drawdown(valid, ret, series), series)


def _side_by_side(left: DataFrame, right: DataFrame, series: Sequence[str]) -> DataFrame:
    """Join tables of one row per series."""
    return left.join(right, list(series), "left") if series else left.crossJoin(right)


def exposure_of_top(df: DataFrame, signal: str, industry: str = "industry",
                    styles: Sequence[str] | None = None, quantile: float = 0.2,
                    series: Sequence[str] = ()) -> DataFrame:
    """Top bucket against universe: industry share differences and style means."""
    styles = [c for c in (styles or STYLE_NAMES) if c in df.columns]
    known = df.withColumn("_ind", F.coalesce(F.col(industry), F.lit(UNKNOWN_GROUP)))
    n = _number_of_buckets(quantile)
    marked = with_bucket(known.select(*series, "date", "stock_id", signal, "_ind", *styles),
                         signal, n, series)
    return exposure_of_members(marked.withColumn("_top", F.col("bucket") == n - 1), styles, series)


def exposure_of_members(marked: DataFrame, styles: Sequence[str],
                        series: Sequence[str] = ()) -> DataFrame:
    """Exposures from rows flagged ``_top``, in one aggregation by industry."""
    top = F.coalesce(F.col("_top"), F.lit(False))
    cells = settle(marked.groupBy(*series, "_ind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(top).alias("n_top"),
        *(F.sum(F.when(top, F.col(c).cast("double"))).alias(f"s_{c}") for c in styles),
        *(F.count_if(top & F.col(c).isNotNull()).alias(f"n_{c}") for c in styles)))
    shares = _exposures(cells, series)
    if not styles:
        return shares
    means = cells.groupBy(*series).agg(*(
        ratio(F.sum(f"s_{c}"), F.sum(f"n_{c}").cast("double")).alias(c) for c in styles))
    return shares.unionByName(_style_rows(means, styles, series))


def _exposures(cells: DataFrame, series: Sequence[str]) -> DataFrame:
    """Share of each industry in the top bucket less its share of the universe."""
    whole = Window.partitionBy(*series, F.lit(0))
    return cells.select(
        *series, F.lit("industry").alias("exposure_type"), F.col("_ind").alias("name"),
        (F.coalesce(F.col("n_top") / F.nullif(F.sum("n_top").over(whole), F.lit(0)), F.lit(0.0))
         - F.col("n") / F.sum("n").over(whole)).alias("exposure"))


def _style_rows(means: DataFrame, styles: Sequence[str], series: Sequence[str]) -> DataFrame:
    return means.unpivot(list(series), list(styles), "name", "exposure").withColumn("exposure_type", F.lit("style"))


def yearly_performance(df: DataFrame, signal: str, ret: str, n_groups: int = 5,
                       series: Sequence[str] = ()) -> DataFrame:
    """Information coefficients and long-short results per calendar year."""
    rank_ic = settle(daily_rank_ic(df, signal, ret, series))
    buckets = bucket_returns(df, signal, ret, n_groups, series)
    return _by_year(settle(daily_ic(df, signal, ret, series)), rank_ic,
                    settle(long_short(buckets, n_groups, series)), series)


def _by_year(ic: DataFrame, rank_ic: DataFrame, ls: DataFrame, series: Sequence[str]) -> DataFrame:
    keys = [*series, "year"]
    ic, rank_ic, ls = (t.withColumn("year", F.year("date")) for t in (ic, rank_ic, ls))
    left = ic_summary(ic, "ic", keys).select(*keys, "ic_mean", "icir")
    right = rank_ic.groupBy(*keys).agg(F.avg("rank_ic").alias("rankic_mean"))
    gain = ls.groupBy(*keys).agg((F.avg("long_short_ret") * PERIODS).alias("ls_ann_return"))
    fall = drawdown(ls, "long_short_ret", keys, "ls_max_drawdown")
    return (left.join(right, keys, "left").join(gain, keys, "left").join(fall, keys, "left"))


def stack_scores(signals: DataFrame, score_columns: Sequence[str] = SCORE_COLUMNS) -> DataFrame:
    """One row per score column, so that all of them are evaluated in one plan."""
    have = [c for c in score_columns if c in signals.columns]
    ids = [c for c in signals.columns if c not in have]
    return signals.unpivot(ids, have, "score_col", "score")


def stack_returns(returns: DataFrame) -> DataFrame:
    """(date, stock_id, horizon, ret) from ``future_return_<h>d`` columns."""
    found = [c for c in returns.columns if c.startswith("future_return_") and c.endswith("d")]
    long = returns.unpivot(["date", "stock_id"], found, "_name", "ret")
    return long.select("date", "stock_id", "ret",
                       F.regexp_extract("_name", r"(\d+)d$", 1).cast("int").alias("horizon"))


def evaluate_signals(signals: DataFrame, returns: DataFrame, exposures: DataFrame | None = None,
                     n_groups: int = 5, quantile: float = 0.1,
                     score_columns: Sequence[str] = SCORE_COLUMNS) -> dict[str, DataFrame]:
    """Every table of the evaluation for all models and score columns at once.

    Each model is scored on the return column of its own horizon.
    """
    series = ["model_name", "score_col"]
    tags = ["model_family", "objective_type", "label_type", "horizon"]
    by = [*series, "date"]
    ahead = stack_returns(returns)
    # One row per model.
    tag_rows = stored(signals.groupBy("model_name").agg(*(F.first(t).alias(t) for t in tags),
                                                        F.collect_set("horizon").alias("_horizons")), "tags")
    wanted = {h for r in tag_rows.select("_horizons").collect() for h in r[0]}
    missing = [h for h in wanted if f"future_return_{h}d" not in returns.columns]
    if missing:
        raise ValueError(f"return table lacks horizons {sorted(missing)}")
    have = [c for c in score_columns if c in signals.columns]
    joined = join_rows(signals.select("date", "stock_id", "model_name", "horizon", *have), ahead, ["date", "stock_id", "horizon"])
    styles, grouped = [], "industry" in (exposures if exposures is not None else returns).columns
    if exposures is not None:
        styles = [c for c in STYLE_NAMES if c in exposures.columns]
    if grouped:
        where = exposures if exposures is not None else returns
        joined = join_rows(joined, where.select("date", "stock_id", F.col("industry").alias("_ind")), ["date", "stock_id"],
                           "left" if exposures is not None else "inner")
    n_top = _number_of_buckets(quantile)
    # Keys, score and return of all rows are kept; styles are joined to the top rows alone.
    kept = [*by, "stock_id", "score", "ret", *(["_ind"] if grouped else [])]
    long = stored(stack_scores(joined.drop("horizon"), score_columns).select(*kept), "long")
    ranked = pair_ranks(long, by, "score", "ret", "stock_id")
    both = F.col("_rank").isNotNull()
    ranked = stored(ranked.select(
        *by, "stock_id", *(["_ind"] if grouped else []),
        (F.coalesce(bucket_of(n_top, "_all", "_all_n") == n_top - 1, F.lit(False))).alias("_top"),
        F.when(both, bucket_of(n_groups, "_rank", "_n")).alias("bucket"), F.when(both, F.col("score")).alias("score"),
        F.when(both, F.col("ret")).alias("ret"), "_r1", "_r2"), "ranked")
    cells = [F.struct(F.lit(b).alias("bucket"), F.avg(F.when(F.col("bucket") == b, F.col("ret"))).alias("group_return"),
                      F.count_if(F.col("bucket") == b).alias("n_stocks")) for b in range(n_groups)]
    # One row per date and series, from which all but turnover and exposures follow.
    days = stored(ranked.groupBy(*by).agg(
        pearson("score", "ret").alias("ic"), pearson("_r1", "_r2").alias("rank_ic"), F.count("bucket").alias("n_pairs"),
        F.count_if("_top").alias("size"), F.array(*cells).alias("groups")), "days")
    daily = days.filter("n_pairs > 0").select(*by, "ic", "rank_ic")
    buckets = days.select(*by, F.explode("groups").alias("g")).select(*by, "g.*").filter("n_stocks > 0")
    ls = days.select(*by, F.col("groups")[n_groups - 1]["group_return"].alias("long_ret"),
                     F.col("groups")[0]["group_return"].alias("short_ret")).filter(
        "long_ret IS NOT NULL AND short_ret IS NOT NULL").withColumn("long_short_ret", F.col("long_ret") - F.col("short_ret"))
    top = ranked.filter("_top")
    turnover = stored(turnover_of_sets(top, series, days.filter("size > 0").select(*by, "size")), "turnover")
    out = {"ic_timeseries": daily, "group_return": buckets, "long_short_return": ls,
           "turnover": turnover, "yearly": _by_year(daily, daily.select(*by, "rank_ic"), ls, series)}
    if grouped:
        shares = stored(ranked.groupBy(*series, F.coalesce("_ind", F.lit(UNKNOWN_GROUP)).alias("_ind")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("_top").alias("n_top")), "shares")
        out["exposure_report"] = _exposures(shares, series)
        if styles:
            held = join_rows(top.select(*by, "stock_id"), exposures.select("date", "stock_id", *styles), ["date", "stock_id"], "left")
            means = held.groupBy(*series).agg(*(F.avg(c).alias(c) for c in styles))
            # A series without top rows has exposures, all null.
            means = shares.select(*series).distinct().join(means, series, "left")
            out["exposure_report"] = out["exposure_report"].unionByName(_style_rows(means, styles, series))
    ics = ic_summary(daily, "ic", series).select(*series, "ic_mean", "icir")
    ranks = ic_summary(daily, "rank_ic", series).select(
        *series, F.col("ic_mean").alias("rank_ic_mean"), F.col("icir").alias("rank_icir"))
    gains = annualize(ls, "long_short_ret", series).select(
        *series, F.col("ann_return").alias("ls_ann_return"), F.col("sharpe").alias("ls_sharpe"),
        F.col("max_drawdown").alias("ls_max_drawdown"))
    longs = ls.groupBy(*series).agg((F.avg("long_ret") * PERIODS).alias("long_ann_return"))
    moves = turnover.groupBy(*series).agg(F.avg("turnover").alias("top_turnover_mean"))
    summary = ics
    for part in (ranks, gains, longs, moves):
        summary = summary.join(part, series, "left")
    out["model_summary"] = summary.join(tag_rows.drop("_horizons"), "model_name").select(
        *series, *tags, *(c for c in summary.columns if c not in series))
    return out


def compare_models(summary: DataFrame) -> DataFrame:
    """Mean results along each dimension, by grouping sets."""
    measures = ["ic_mean", "rank_ic_mean", "icir", "ls_ann_return"]
    text = [F.col(c).cast("string").alias(c) for c in COMPARED]
    rows = summary.select(*text, *measures)
    sets = rows.groupingSets([[F.col(c)] for c in COMPARED], *(F.col(c) for c in COMPARED)).agg(
        F.grouping_id().alias("_set"), *(F.avg(m).alias(m) for m in measures))
    width = len(COMPARED)
    name, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(COMPARED):
        here = F.col("_set") == (2 ** width - 1) - 2 ** (width - 1 - i)
        name, level = F.when(here, F.lit(c)).otherwise(name), F.when(here, F.col(c)).otherwise(level)
    return sets.select(name.alias("dimension"), level.alias("level"), *measures)
