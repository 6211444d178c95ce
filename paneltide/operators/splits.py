"""Walk-forward windows and the train / valid / test rows they select."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneltide.functions.lookup import attach
from paneltide.session import settle
from paneltide.sources.panel_store import calendar

WINDOW_FIELDS = ["window_id", "train_start", "train_end", "valid_start", "valid_end",
                 "test_start", "test_end"]


def _shift(day, months):
    """Move by whole months; days after the 28th count as the 28th."""
    clamped = F.when(F.dayofmonth(day) > 28, F.date_add(F.trunc(day, "month"), 27)).otherwise(day)
    return F.when(months == 0, day).otherwise(F.add_months(clamped, months))


def _finish(steps: DataFrame, valid_years: int, test_months: int, prefix: str) -> DataFrame:
    last = F.col("end")
    out = (steps
           .withColumn("test_start", _shift(F.col("valid_start"), F.lit(12 * valid_years)))
           .filter(F.col("test_start") <= last)
           .withColumn("train_end", F.date_sub("valid_start", 1))
           .withColumn("valid_end", F.date_sub("test_start", 1))
           .withColumn("test_end", F.least(
               F.date_sub(_shift(F.col("test_start"), F.lit(test_months)), 1), last))
           .withColumn("window_id", F.format_string(
               prefix + "%03d_%s", F.col("n"), F.date_format("test_start", "yyyyMMdd"))))
    out = settle(out.select(*WINDOW_FIELDS))
    if out.isEmpty():
        raise ValueError("no window starts its test in the span; check the window sizes")
    return out


def _span(spark: SparkSession, start: str | DataFrame, end: str | None) -> DataFrame:
    """One row (start, end): the given dates, or the first and last of a calendar (date, ...)."""
    if isinstance(start, DataFrame):
        return start.agg(F.min("date").alias("start"), F.max("date").alias("end")).where("start IS NOT NULL")
    return spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))


def _steps(span: DataFrame, step_months: int) -> DataFrame:
    """One row per step between the ends of the span: a few hundred."""
    last = f"int(floor(months_between(end, start) / {step_months})) + 1"
    return span.select("start", "end", F.expr(f"explode(sequence(0, greatest({last}, 0))) AS n"))


def rolling_windows(spark: SparkSession, start: str | DataFrame, end: str | None = None, train_years: int = 5,
                    valid_years: int = 1, test_months: int = 3,
                    step_months: int = 3) -> DataFrame:
    """Fixed-length train spans that slide by ``step_months``.

    ``start`` and ``end`` are dates, or ``start`` is a calendar whose ends are taken.
    """
    steps = (_steps(_span(spark, start, end), step_months)
             .withColumn("train_start", _shift(F.col("start"), F.col("n") * step_months))
             .withColumn("valid_start", _shift(F.col("train_start"), F.lit(12 * train_years))))
    return _finish(steps, valid_years, test_months, "w")


def expanding_windows(spark: SparkSession, start: str | DataFrame, end: str | None = None, min_train_years: int = 3,
                      valid_years: int = 1, test_months: int = 3,
                      step_months: int = 3) -> DataFrame:
    """Train spans that all begin at ``start`` and grow."""
    first = _shift(F.col("start"), F.lit(12 * min_train_years))
    steps = (_steps(_span(spark, start, end), step_months)
             .withColumn("train_start", F.col("start"))
             .withColumn("valid_start", _shift(first, F.col("n") * step_months)))
    return _finish(steps, valid_years, test_months, "e")


def split_dates(windows: DataFrame, days: DataFrame, embargo_days: int) -> DataFrame:
    """(date, window_id, split): the embargo cuts trading days off train and valid ends.

    Windows and calendar are both small; their range join is a broadcast one.
    """
    # The windows come from the parameters: a few hundred rows at most.
    inside = settle(days).join(F.broadcast(windows), F.col("date").between(
        F.col("train_start"), F.col("test_end")))
    cut = inside.groupBy("window_id").agg(
        F.max(F.when(F.col("date") <= F.col("train_end"), F.col("day_no"))).alias("_t"),
        F.max(F.when(F.col("date") <= F.col("valid_end"), F.col("day_no"))).alias("_v"))
    marked = inside.join(F.broadcast(cut), "window_id").withColumn("split", F.expr(
        f"CASE WHEN date <= train_end AND day_no <= _t - {embargo_days} THEN 'train' "
        f"WHEN date BETWEEN valid_start AND valid_end AND day_no <= _v - {embargo_days} "
        "THEN 'valid' WHEN date >= test_start THEN 'test' END"))
    return marked.filter("split IS NOT NULL").select("date", "window_id", "split")


def window_index(windows: DataFrame, days: DataFrame, embargo_days: int) -> DataFrame:
    """(date, uses): for every date one array of (window_id, split) that use it."""
    return split_dates(windows, days, embargo_days).groupBy("date").agg(
        F.array_sort(F.collect_list(F.struct("window_id", "split"))).alias("uses"))


def indexed_rows(windows: DataFrame, features: DataFrame, labels: DataFrame,
                 embargo_days: int = 20) -> DataFrame:
    """Labelled rows that some window uses, each once, with the array ``uses`` of its date."""
    index = window_index(windows, calendar(labels), embargo_days)
    return attach(features.join(labels, ["date", "stock_id"]), index, ["date"], "inner")


def windowed_rows(windows: DataFrame, features: DataFrame, labels: DataFrame,
                  embargo_days: int = 20) -> DataFrame:
    """Labelled rows of every window and split, a row once for each window that uses it.

    For counts and audits use ``indexed_rows``, which does not repeat rows.
    """
    rows = indexed_rows(windows, features, labels, embargo_days)
    return rows.withColumn("_use", F.explode("uses")).drop("uses").select(
        *(c for c in rows.columns if c != "uses"), "_use.window_id", "_use.split")


def rows_by_window(rows: DataFrame) -> DataFrame:
    """(window_id, split, date, n_rows) of ``indexed_rows``: rows are counted per date, then dates
    are repeated for their windows."""
    dates = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"), F.first("uses").alias("uses"))
    return dates.select("date", "n_rows", F.explode("uses").alias("_use")).select("_use.*", "date", "n_rows")


def window_sizes(windows: DataFrame, rows: DataFrame, days: DataFrame, embargo_days: int) -> DataFrame:
    """The windows with the trading days and rows of their splits; 0 where a split is empty."""
    known = split_dates(windows, days, embargo_days)
    counts = attach(known, rows.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows")), ["date"])
    sizes = counts.groupBy("window_id").agg(*(F.expr(e.format(s)) for s in ("train", "valid", "test") for e in (
        "count_if(split = '{0}') AS {0}_days",
        "coalesce(sum(CASE WHEN split = '{0}' THEN n_rows END), 0) AS {0}_rows")))
    return windows.join(sizes, "window_id", "left").fillna(0)


def window_rows(windows: DataFrame, window_id: str, features: DataFrame, labels: DataFrame,
                embargo_days: int = 20) -> DataFrame:
    """Labelled rows of one window with their split; raises if one of the splits is empty.

    The window's bounds filter both inputs before they are joined. Nothing is copied: the rows are
    read from the inputs whenever they are used.
    """
    one = windows.filter(F.col("window_id") == window_id)
    span = one.first()
    inside = F.col("date").between(F.lit(span["train_start"]), F.lit(span["test_end"]))
    labels = labels.filter(inside)
    dates = split_dates(one, calendar(labels), embargo_days)
    rows = attach(features.filter(inside).join(labels, ["date", "stock_id"]), dates, ["date"], "inner")
    found = {r["split"] for r in rows.select("split").distinct().collect()}
    empty = [s for s in ("train", "valid", "test") if s not in found]
    if empty:
        raise ValueError(f"window {window_id}: empty {', '.join(empty)} split")
    return rows


def split_audit(rows: DataFrame) -> DataFrame:
    """Per window: the bounds of its splits and whether their order is broken.

    ``rows`` are those of ``indexed_rows`` or of ``windowed_rows``.
    """
    by_date = (rows_by_window(rows) if "uses" in rows.columns else
               rows.groupBy("window_id", "split", "date").agg(F.count(F.lit(1)).alias("n_rows")))

    def edge(f, split):
        return f(F.when(F.col("split") == split, F.col("date")))
    bounds = by_date.groupBy("window_id").agg(
        edge(F.max, "train").alias("train_max"), edge(F.min, "valid").alias("valid_min"),
        edge(F.max, "valid").alias("valid_max"), edge(F.min, "test").alias("test_min"),
        *(F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n_rows"))), F.lit(0)).alias(f"n_{s}")
          for s in ("train", "valid", "test")))
    good = ((F.col("train_max") < F.col("valid_min")) & (F.col("valid_max") < F.col("test_min")))
    return bounds.withColumn("leaks", (~F.coalesce(good, F.lit(False))).cast("int"))


def test_overlap(windows: DataFrame) -> DataFrame:
    """Pairs of neighbouring windows whose test spans overlap."""
    order = Window.orderBy("test_start")
    nxt = windows.withColumn("next_id", F.lead("window_id").over(order)).withColumn(
        "next_start", F.lead("test_start").over(order))
    return nxt.filter(F.col("next_start") <= F.col("test_end")).select(
        "window_id", "next_id", "next_start", "test_end")
