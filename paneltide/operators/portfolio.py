"""Long-short and benchmark-relative accounting of given signals or weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.functions.lookup import attach
from paneltide.functions.moments import UNKNOWN_GROUP, ratio
from paneltide.functions.order import average_rank, percentile_of, quantile_table, shift_rows
from paneltide.operators.evaluation import PERIODS, _side_by_side, annualize, drawdown
from paneltide.session import settle
from paneltide.sources.panel_store import calendar

KEY = ["date", "stock_id"]
STYLE_NAMES = ["log_mktcap", "beta", "volatility", "liquidity", "value", "growth", "quality"]
TINY = 1e-12


def next_returns(returns: DataFrame, ret: str = "return") -> DataFrame:
    """The entity's next return, aligned to the date a position is taken."""
    return shift_rows(returns, ["stock_id"], "date", ret, {"next_return": 1})


def long_short_weights(signal: DataFrame, top: float = 0.1, bottom: float = 0.1,
                       weighting: str = "equal", score: str = "signal_score") -> DataFrame:
    """Long the top and short the bottom of each date; legs sum to +1 and -1."""
    if weighting not in ("equal", "score"):
        raise ValueError(f"unknown weighting: {weighting}")
    ranked = average_rank(signal.dropna(subset=[score]).select(*KEY, score), ["date"], score,
                          "stock_id")
    pct = percentile_of()
    sides = F.array_compact(F.array(F.when(pct >= 1.0 - top, F.lit(1)),
                                    F.when(pct <= bottom, F.lit(-1))))
    legs = ranked.select(*KEY, score, F.explode(sides).alias("side"))
    size = F.lit(1.0)
    if weighting == "score":
        ends = legs.groupBy("date", "side").agg(F.min(score).alias("_min"),
                                                F.max(score).alias("_max"))
        legs = attach(legs, ends, ["date", "side"])
        size = F.when(F.col("side") > 0, F.col(score) - F.col("_min")).otherwise(
            F.col("_max") - F.col(score)) + TINY
    legs = legs.withColumn("_size", size)
    totals = legs.groupBy("date", "side").agg(F.sum("_size").alias("_total"))
    return attach(legs, totals, ["date", "side"]).select(
        *KEY, (F.col("side") * F.col("_size") / F.col("_total")).alias("weight"))


def neutralize_weights(weights: DataFrame, exposures: DataFrame, industry: bool = False,
                       size: bool = False, beta: bool = False) -> DataFrame:
    """Approximate neutrality: equal industry legs, then projections off size and beta.

    An industry with a single leg keeps its net exposure, and the projections
    are not scaled back to unit legs.
    """
    have = [c for c in ("industry", "log_mktcap", "beta") if c in exposures.columns]
    out = weights.join(exposures.select(*KEY, *have), KEY, "left")
    if industry and "industry" in have:
        plus, minus = F.greatest("weight", F.lit(0.0)), F.greatest(-F.col("weight"), F.lit(0.0))
        out = out.withColumn("_ind", F.coalesce("industry", F.lit(UNKNOWN_GROUP)))
        legs = out.groupBy("date", "_ind").agg(F.sum(plus).alias("_plus"),
                                               F.sum(minus).alias("_minus"))
        out = attach(out, legs, ["date", "_ind"]).withColumn(
            "weight", plus / F.greatest("_plus", F.lit(TINY))
            - minus / F.greatest("_minus", F.lit(TINY))).drop("_plus", "_minus", "_ind")
        longs = out.groupBy("date").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("_long"))
        out = attach(out, longs, ["date"]).withColumn(
            "weight", F.col("weight") / F.greatest("_long", F.lit(TINY))).drop("_long")
    for wanted, column in ((size, "log_mktcap"), (beta, "beta")):
        if wanted and column in have:
            out = out.withColumn("_x", F.coalesce(F.col(column).cast("double"), F.lit(0.0)))
            n = F.count(F.lit(1))
            fit = out.groupBy("date").agg(
                F.avg("_x").alias("_mean"),
                (n * F.covar_pop("weight", "_x")
                 / F.greatest(n * F.var_pop("_x"), F.lit(TINY))).alias("_slope"))
            out = attach(out, fit, ["date"]).withColumn(
                "weight", F.col("weight") - F.col("_slope") * (F.col("_x") - F.col("_mean"))
            ).drop("_x", "_mean", "_slope")
    return out.select(*KEY, "weight")


def long_short_return(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Return of each leg from the date's close to the next row; a missing return is 0."""
    joined = weights.join(next_returns(returns).select(*KEY, "next_return"), KEY, "left")
    gain = F.col("weight") * F.coalesce("next_return", F.lit(0.0))
    return (joined.groupBy("date")
            .agg(F.sum(F.when(F.col("weight") > 0, gain).otherwise(0.0)).alias("long_ret"),
                 F.sum(F.when(F.col("weight") < 0, gain).otherwise(0.0)).alias("short_ret"))
            .withColumn("ls_ret", F.col("long_ret") + F.col("short_ret")))


def turnover_series(weights: DataFrame, mode: str = "calendar") -> DataFrame:
    """Two-sided turnover per rebalance date; the first date is a full build-up.

    ``calendar`` compares with the previous rebalance date, a missing weight
    counting 0. ``held_today`` leaves out positions that are gone. ``row_lag``
    compares with the entity's own previous row.
    """
    if mode == "row_lag":
        moved = shift_rows(weights, ["stock_id"], "date", "weight", {"_before": -1}).withColumn(
            "_move", F.coalesce("weight", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0)))
        return moved.groupBy("date").agg(F.sum(F.abs("_move")).alias("turnover"))
    if mode not in ("calendar", "held_today"):
        raise ValueError(f"unknown turnover mode: {mode}")
    days = settle(calendar(weights))
    numbered = attach(weights, days, ["date"], settled=True)
    w = F.coalesce("weight", F.lit(0.0))
    # Each weight is added on its date and taken off on the next one.
    moves = (numbered.select("stock_id", "day_no", w.alias("move"), F.lit(1).alias("held"))
             .unionByName(numbered.select("stock_id", (F.col("day_no") + 1).alias("day_no"),
                                          (-w).alias("move"), F.lit(0).alias("held"))))
    net = moves.groupBy("stock_id", "day_no").agg(F.abs(F.sum("move")).alias("move"),
                                                  F.max("held").alias("held"))
    if mode == "held_today":
        net = net.filter("held = 1")
    return (attach(net, days, ["day_no"], "inner", settled=True)
            .groupBy("date").agg(F.sum("move").alias("turnover")))


def rebalance_dates(days: DataFrame, frequency: str) -> DataFrame:
    """Each date with the rebalance date of its period (its first date)."""
    if frequency == "daily":
        return days.select("date", F.col("date").alias("rebalance_date"))
    period = {"weekly": F.struct(F.expr("extract(YEAROFWEEK FROM date)").alias("y"),
                                 F.weekofyear("date").alias("p")),
              "monthly": F.struct(F.year("date").alias("y"), F.month("date").alias("p"))}
    if frequency not in period:
        raise ValueError(f"unknown rebalance frequency: {frequency}")
    tagged = settle(days.select("date", period[frequency].alias("_p")))
    firsts = tagged.groupBy("_p").agg(F.min("date").alias("rebalance_date"))
    return tagged.join(firsts, "_p").select("date", "rebalance_date")


def rebalance_rows(signal: DataFrame, frequency: str) -> DataFrame:
    """Only the rows of rebalance dates."""
    if frequency == "daily":
        return signal
    firsts = rebalance_dates(calendar(signal), frequency).select(
        F.col("rebalance_date").alias("date")).distinct()
    return attach(signal, firsts, ["date"], "left_semi")


def hold_weights(weights: DataFrame, days: DataFrame, frequency: str) -> DataFrame:
    """Carry the weights of each rebalance date over the dates until the next one."""
    spans = rebalance_dates(days, frequency).withColumnsRenamed(
        {"date": "held_on", "rebalance_date": "date"})
    return attach(weights, spans, ["date"], "inner").drop("date").withColumnRenamed(
        "held_on", "date").select(*weights.columns)


#: Settings of a long-short backtest that a caller may leave out.
LONG_SHORT_DEFAULTS = {"rebalance_freq": "daily", "top_quantile": 0.1, "bottom_quantile": 0.1,
                       "weighting": "equal", "hold": False, "cost_rate": 0.0015}


def target_weights(signal: DataFrame, own: dict, exposures: DataFrame | None) -> DataFrame:
    """Weights on rebalance days, neutral to what is asked for, held in between if asked for."""
    picked = long_short_weights(rebalance_rows(signal, own["rebalance_freq"]), own["top_quantile"],
                                own["bottom_quantile"], own["weighting"])
    neutral = {kind: bool(own.get(f"{kind}_neutral")) for kind in ("industry", "mktcap", "beta")}
    if exposures is not None and True in neutral.values():
        picked = neutralize_weights(picked, exposures, *neutral.values())
    return hold_weights(picked, calendar(signal), own["rebalance_freq"]) if own["hold"] else picked


def net_of_costs(gross: DataFrame, moved: DataFrame, cost_rate: float) -> DataFrame:
    """Daily leg returns with turnover and what is left after its cost."""
    traded = gross.join(moved, "date", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    return traded.withColumn("ls_ret_net", F.col("ls_ret") - F.col("turnover") * float(cost_rate))


def long_short_backtest(signal: DataFrame, returns: DataFrame, config: dict,
                        exposures: DataFrame | None = None,
                        turnover_mode: str = "calendar") -> dict[str, DataFrame]:
    """Weights, daily gross and net returns, summary, months and style exposure."""
    own = {**LONG_SHORT_DEFAULTS, **config.get("long_short", config)}
    tables = {"weights": settle(target_weights(signal, own, exposures))}
    moved = turnover_series(tables["weights"], turnover_mode)
    tables["daily"] = settle(net_of_costs(long_short_return(tables["weights"], returns), moved, own["cost_rate"]))
    tables["summary"], tables["monthly"] = long_short_performance(tables["daily"])
    if exposures is not None:
        tables["style_exposure"] = style_exposure(tables["weights"], exposures)
    return tables


def long_short_performance(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of annual figures, and the monthly returns."""
    gross = annualize(daily, "ls_ret")
    net = annualize(daily, "ls_ret_net").select(F.col("ann_return").alias("ann_return_net"),
                                                F.col("sharpe").alias("sharpe_net"))
    legs = daily.agg((F.avg("long_ret") * PERIODS).alias("long_ann_return"),
                     (F.avg("short_ret") * PERIODS).alias("short_ann_return"),
                     F.avg("turnover").alias("avg_turnover"))
    months = daily.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.sum("ls_ret").alias("monthly_return"))
    return _side_by_side(_side_by_side(gross, net, ()), legs, ()), months


def industry_exposure(weights: DataFrame, exposures: DataFrame, weight: str = "weight",
                      name: str = "industry_weight") -> DataFrame:
    """Weight per date and industry."""
    joined = weights.join(exposures.select(*KEY, "industry"), KEY, "left")
    group = F.coalesce("industry", F.lit(UNKNOWN_GROUP)).alias("industry")
    return joined.groupBy("date", group).agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias(name))


def active_industry_exposure(weights: DataFrame, benchmark: DataFrame,
                             exposures: DataFrame) -> DataFrame:
    """Portfolio less benchmark weight per date and industry."""
    port = industry_exposure(weights, exposures, "weight", "port_w")
    bench = industry_exposure(benchmark, exposures, "benchmark_weight", "bench_w")
    zero = F.lit(0.0)
    return (port.join(bench, ["date", "industry"], "full")
            .select("date", "industry", F.coalesce("port_w", zero).alias("port_w"),
                    F.coalesce("bench_w", zero).alias("bench_w"))
            .withColumn("active_w", F.col("port_w") - F.col("bench_w")))


def style_exposure(weights: DataFrame, exposures: DataFrame,
                   styles: Sequence[str] | None = None, weight: str = "weight") -> DataFrame:
    """Sum of weight times style per date; a null style counts 0."""
    styles = [c for c in (styles or STYLE_NAMES) if c in exposures.columns]
    joined = weights.join(exposures.select(*KEY, *styles), KEY, "left")
    return joined.groupBy("date").agg(*(
        F.coalesce(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col(weight)),
                   F.lit(0.0)).alias(c) for c in styles))


def normalize_benchmark(weights: DataFrame) -> DataFrame:
    """Benchmark weights scaled to 1 per date (equal if they sum to 0), and active weights."""
    bench = F.coalesce(F.col("benchmark_weight").cast("double"), F.lit(0.0))
    totals = weights.groupBy("date").agg(F.sum(bench).alias("_total"),
                                         F.count(F.lit(1)).alias("_n"))
    scaled = F.when(F.col("_total") > 0, ratio(bench, F.col("_total"))).otherwise(1 / F.col("_n"))
    return (attach(weights, totals, ["date"]).withColumn("benchmark_weight", scaled)
            .withColumn("active_weight", F.col("weight") - F.col("benchmark_weight"))
            .drop("_total", "_n"))


def benchmark_backtest(weights: DataFrame, returns: DataFrame, config: dict,
                       exposures: DataFrame | None = None,
                       turnover_mode: str = "held_today") -> dict[str, DataFrame]:
    """Portfolio against benchmark for given weights.

    ``weights``: date, stock_id, weight, benchmark_weight and optionally
    alpha_score.
    """
    cost_rate = float(config.get("cost_rate", 0.0015))
    value = float(config.get("constraints", {}).get("portfolio_value", 1e8))
    held = settle(normalize_benchmark(weights))
    alpha = F.coalesce("alpha_score", F.lit(0.0)) if "alpha_score" in held.columns else F.lit(0.0)
    joined = held.join(next_returns(returns).select(*KEY, "next_return"), KEY, "left")
    ahead = F.coalesce("next_return", F.lit(0.0))
    sums = joined.groupBy("date").agg(
        F.sum(F.col("weight") * ahead).alias("_gross"),
        F.sum(F.col("benchmark_weight") * ahead).alias("benchmark_return"),
        F.sum(alpha * F.col("active_weight")).alias("expected_alpha"))
    moved = turnover_series(held.select(*KEY, "weight"), turnover_mode)
    daily = settle(sums.join(moved, "date").select(
        "date", (F.col("_gross") - F.col("turnover") * cost_rate).alias("portfolio_return"),
        "benchmark_return", "turnover", (F.col("turnover") * value).alias("traded_value"),
        "expected_alpha", (F.col("turnover") * cost_rate).alias("cost"))
        .withColumn("excess_return", F.col("portfolio_return") - F.col("benchmark_return")))
    risk = F.stddev_samp("excess_return") * F.sqrt(F.lit(float(PERIODS)))
    mean = F.avg("excess_return") * PERIODS
    summary = _side_by_side(
        daily.agg(mean.alias("ann_excess_return"), risk.alias("tracking_error"),
                  ratio(mean, risk).alias("information_ratio"),
                  F.avg("turnover").alias("avg_turnover")),
        drawdown(daily, "excess_return"), ())
    out = {"holdings": held, "daily": daily, "summary": summary}
    if exposures is not None:
        out["industry_exposure"] = active_industry_exposure(held, held, exposures)
        out["style_exposure"] = style_exposure(held, exposures)
    return out


def structured_risk(active: DataFrame, exposures: DataFrame, styles: Sequence[str],
                    industry: str | None = "industry", vol: str | None = "volatility",
                    factor_cov: DataFrame | None = None, factor_var: float = 1e-4,
                    weight: str = "active_weight") -> DataFrame:
    """Daily variance a'BFB'a + sum(d a^2) and annual tracking error, per date.

    Weights are summed to factor level, so no stock-by-stock matrix exists.
    ``factor_cov`` has columns f1, f2, cov over the factor names; without it
    the factors are independent with variance ``factor_var``.
    """
    need = dict.fromkeys([*styles, *([industry] if industry else []), *([vol] if vol else [])])
    have = [c for c in need if c in exposures.columns]
    a = active.select(*KEY, F.col(weight).alias("_a")).join(
        exposures.select(*KEY, *have), KEY, "left")
    styles = [c for c in styles if c in have]
    parts = F.array(*(F.struct(F.lit(c).alias("factor"),
                               (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col("_a"))
                               .alias("b")) for c in styles))
    if industry and industry in have:
        group = F.concat(F.lit("industry_"), F.coalesce(F.col(industry), F.lit(UNKNOWN_GROUP)))
        parts = F.concat(parts, F.array(F.struct(group.alias("factor"), F.col("_a").alias("b"))))
    loads = settle(a.select("date", F.explode(parts).alias("p")).groupBy("date", "p.factor")
                   .agg(F.sum("p.b").alias("b")))
    if factor_cov is None:
        common = loads.groupBy("date").agg((F.sum(F.col("b") ** 2) * factor_var).alias("_f"))
    else:
        second = loads.select("date", F.col("factor").alias("f2"), F.col("b").alias("b2"))
        common = (attach(loads.withColumnRenamed("factor", "f1"), factor_cov, ["f1"], "inner")
                  .join(second, ["date", "f2"]).groupBy("date")
                  .agg(F.sum(F.col("b") * F.col("b2") * F.col("cov")).alias("_f")))
    if vol and vol in have:
        a = attach(a, quantile_table(a, ["date"], [vol], (0.5,)), ["date"])
        spec = F.coalesce(F.col(vol).cast("double"), F.col(f"{vol}__q0")) ** 2 / PERIODS
    else:
        spec = F.lit(0.02 ** 2)
    own = a.groupBy("date").agg(F.sum(F.greatest(spec, F.lit(1e-8)) * F.col("_a") ** 2).alias("_s"))
    variance = F.coalesce("_f", F.lit(0.0)) + F.col("_s")
    return own.join(common, "date", "left").select(
        "date", variance.alias("variance"), F.sqrt(variance * PERIODS).alias("tracking_error"))


def constraint_audit(weights: DataFrame, exposures: DataFrame, limits: dict,
                     styles: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Per date and constraint: the binding value, its limit and whether it holds.

    ``weights``: date, stock_id, weight, benchmark_weight and optionally adv.
    Limits that are not given, or whose column is absent, are not reported.
    """
    held = settle(normalize_benchmark(weights))
    names = [("budget", "abs(sum(weight) - 1)", 0.0),
             ("non_negative", "max(greatest(-weight, 0D))", 0.0)]
    if limits.get("max_weight") is not None:
        names.append(("max_weight", "max(weight)", limits["max_weight"]))
    if limits.get("max_active_weight") is not None:
        names.append(("max_active_weight", "max(abs(active_weight))", limits["max_active_weight"]))
    if limits.get("adv_participation") is not None and "adv" in held.columns:
        value, share = limits.get("portfolio_value", 1e8), limits["adv_participation"]
        names.append(("capacity", f"max({float(value)!r}D * weight - {float(share)!r}D "
                      "* coalesce(adv, 0D))", 0.0))
    wide = held.groupBy("date").agg(*(F.expr(e).alias(n) for n, e, _ in names))
    found = [(wide.unpivot(["date"], [n for n, _, _ in names], "constraint", "value"),
              {n: limit for n, _, limit in names})]
    if limits.get("max_industry_active") is not None and "industry" in exposures.columns:
        active = active_industry_exposure(held, held, exposures)
        found.append((active.groupBy("date").agg(F.max(F.abs("active_w")).alias("value"))
                      .withColumn("constraint", F.lit("industry_active")),
                      {"industry_active": limits["max_industry_active"]}))
    bounds = {c: b for c, b in (limits.get("style_bounds") or {}).items()
              if c in exposures.columns}
    if bounds:
        tilt = style_exposure(held, exposures, list(bounds), "active_weight")
        tilt = tilt.select("date", *(F.abs(c).alias(f"style_{c}") for c in bounds))
        found.append((tilt.unpivot(["date"], [f"style_{c}" for c in bounds], "constraint", "value"),
                      {f"style_{c}": b for c, b in bounds.items()}))
    if limits.get("max_tracking_error") is not None:
        risk = structured_risk(held, exposures, styles)
        found.append((risk.select("date", F.col("tracking_error").alias("value"))
                      .withColumn("constraint", F.lit("tracking_error")),
                      {"tracking_error": limits["max_tracking_error"]}))
    if limits.get("max_turnover") is not None:
        first = held.agg(F.min("date").alias("date"))
        moved = turnover_series(held.select(*KEY, "weight"), "held_today").join(
            F.broadcast(first), "date", "left_anti")  # the build-up is not limited
        found.append((moved.select("date", F.col("turnover").alias("value"))
                      .withColumn("constraint", F.lit("turnover")),
                      {"turnover": limits["max_turnover"]}))
    out, caps = None, {}
    for table, limit in found:
        table = table.select("date", "constraint", "value")
        out, caps = table if out is None else out.unionByName(table), caps | limit
    cap = F.create_map(*(F.lit(x) for c, b in caps.items() for x in (c, float(b))))[F.col("constraint")]
    return out.withColumn("limit", cap).withColumn(
        "ok", (F.col("value") <= F.col("limit") + tolerance).cast("int"))
