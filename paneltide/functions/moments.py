"""Per-group means, deviations, correlations and regressions.

Each is one aggregation with map-side partial results, so a large group costs
one small row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions.order import quantile_arrays
from paneltide.functions.wide import (WIDE, aggregates, attach_arrays, cell_aggregates, item, pack, per_cell,
                                       per_group, unpack)
from paneltide.session import stored

UNKNOWN_GROUP = "UNKNOWN"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is null where the divisor is 0."""
    return top / F.nullif(bottom, F.lit(0.0))


def pearson(x: str, y: str) -> Column:
    """Correlation of the complete pairs; null for a constant or single row."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = (F.stddev_samp(F.when(both, F.col(x))) * F.stddev_samp(F.when(both, F.col(y))))
    return ratio(F.covar_samp(F.col(x), F.col(y)), spread)


def standardize(df: DataFrame, by: Sequence[str], columns: Sequence[str],
                names: dict[str, str] | None = None, zero_when_flat: bool = True) -> DataFrame:
    """(x - mean) / sample deviation inside the group.

    A group without spread gives 0 on every row, or null with
    ``zero_when_flat=False``.
    """
    names = names or {}
    if len(columns) > WIDE and not names:
        return unpack(standardize_cells(pack(df, columns), by, len(columns), zero_when_flat), columns).select(*df.columns)
    stats = aggregates(df, by, columns, ("avg({0})", "stddev_samp({0})"), "_stats")
    out = {}
    for k, c in enumerate(columns):
        mean, std = item("_stats", 2 * k), item("_stats", 2 * k + 1)
        z = ratio(F.col(c) - mean, std)
        if zero_when_flat:
            z = F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise(z)
        out[names.get(c, c)] = z
    return attach_arrays(df, stats, by, 2 * len(columns)).withColumns(out).drop("_stats")


def standardize_cells(df: DataFrame, by: Sequence[str], n: int, zero_when_flat: bool = True) -> DataFrame:
    """``standardize`` of the ``n`` values of the array ``_v``."""
    stats = cell_aggregates(df, by, ("avg(v)", "stddev_samp(v)"), "_stats")

    def scored(x: Column, i: Column) -> Column:
        mean, std = F.get("_stats", 2 * i), F.get("_stats", 2 * i + 1)
        z = ratio(x - mean, std)
        return F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise(z) if zero_when_flat else z

    return per_cell(attach_arrays(df, stats, by, 2 * n), scored).drop("_stats")


def standardize_held(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``standardize`` of the values of the array ``_v`` where every group fits a task."""
    def scored(values, missing, table):
        n = (~missing).sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            # Taking a value off first leaves an exact 0 for a column that is the same throughout.
            away = values - values[np.argmin(missing, axis=0), np.arange(values.shape[1])]
            away -= np.where(missing, 0.0, away).sum(axis=0) / n
            std = np.sqrt((np.where(missing, 0.0, away) ** 2).sum(axis=0) / (n - 1))
            flat = (n < 2) | (std == 0)
            return np.where(flat, 0.0, away / std), missing & ~flat

    return per_group(df, by, scored)


def solver() -> Callable:
    """A function that solves one small symmetric system. It is sent to the tasks by value.

    The system is scaled to unit diagonal first; collinear directions get the minimum-norm answer.
    """
    def solved(m: np.ndarray, r: np.ndarray) -> np.ndarray:
        diagonal = np.sqrt(np.diag(m))
        scale = np.where(diagonal > 0, diagonal, 1.0)
        fit, *_ = np.linalg.lstsq(m / np.outer(scale, scale), r / scale, rcond=1e-12)
        return fit / scale

    return solved


def solve_rows(matrix: str, right: str) -> Column:
    """Solve one small flattened symmetric system per row. Used on tables with one row per date only."""
    solved = solver()

    def solve(matrices: pd.Series, rights: pd.Series) -> pd.Series:
        out = []
        for flat, r in zip(matrices, rights):
            r = np.asarray(r, dtype=float)
            out.append(solved(np.asarray(flat, dtype=float).reshape(r.size, r.size), r))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(solve, T.ArrayType(T.DoubleType()))(matrix, right)


def _co_moments(df: DataFrame, by: list[str], group: str, targets: list[str] | None, xs: list[str]) -> DataFrame:
    """(by, group, t, n, y, xs, gs, rs): sums over the usable rows of each target ``t``.

    ``xs`` are the sums of the exposures, ``gs`` of their products (upper triangle), ``rs`` of their
    products with the target. Targets are columns, or the places of the array ``_v`` if None.
    """
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]

    def array(cells: list[str]) -> str:
        return f"array({', '.join(cells)})" if cells else "CAST(array() AS array<double>)"

    def sums(y: str) -> dict[str, str]:
        kept = [f"CASE WHEN {y} IS NOT NULL THEN CAST(`{x}` AS DOUBLE) END" for x in xs]
        return {"n": f"count({y})", "y": f"CAST(sum({y}) AS DOUBLE)", "xs": array([f"sum({k})" for k in kept]),
                "gs": array([f"sum({kept[i]} * `{xs[j]}`)" for i, j in pairs]),
                "rs": array([f"sum(`{x}` * {y})" for x in xs])}

    if targets is None:
        cells = df.select(*by, group, *xs, F.posexplode("_v").alias("t", "v"))
        return cells.groupBy(*by, group, "t").agg(*(F.expr(e).alias(c) for c, e in sums("v").items()))
    cells = [f"named_struct('t', {t}, " + ", ".join(f"'{c}', {e}" for c, e in sums(f"`{y}`").items()) + ")"
             for t, y in enumerate(targets)]
    found = df.groupBy(*by, group).agg(F.expr(f"array({', '.join(cells)})").alias("_cells"))
    return found.select(*by, group, F.explode("_cells").alias("_c")).select(*by, group, "_c.*")


def _regressions(moments: DataFrame, by: list[str], group: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Arrays (by, _slopes) and (by, group, _levels), ``k`` + 1 numbers per target in either.

    The slopes of a target follow a 0; all are null for a ``by`` that has no more usable rows than
    regressors. The levels are the group's means of the target and of the exposures.
    """
    # Regressing on group dummies equals regressing what is centred in each group, so the systems
    # are sums of the within-group co-moments.
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    place = {p: at for at, p in enumerate(pairs)}
    centred = "coalesce(sum({0} - {1} * {2} / nullif(n, 0)), 0D)".format
    matrix = [centred(f"gs[{place[min(i, j), max(i, j)]}]", f"xs[{i}]", f"xs[{j}]") for i in range(k) for j in range(k)]
    vector = [centred(f"rs[{i}]", f"xs[{i}]", "y") for i in range(k)]
    empty = "CAST(array() AS array<double>)"
    systems = moments.groupBy(*by, "t").agg(
        F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_groups"),
        F.expr(f"array({', '.join(matrix)})" if k else empty).alias("_m"),
        F.expr(f"array({', '.join(vector)})" if k else empty).alias("_v"))
    solved = F.when(F.expr(f"_rows > {k} + _groups"), solve_rows("_m", "_v") if k else F.expr(empty))
    fits = systems.select(*by, "t", solved.alias("_b"))

    def in_order(value: Column) -> Column:
        cells = F.array_sort(F.collect_list(F.struct("t", value.alias("v"))))
        return F.flatten(F.transform(cells, lambda x: x["v"]))

    none = F.array_repeat(F.lit(None).cast("double"), k + 1)
    fitted = F.when(F.col("_b").isNull(), none).otherwise(F.concat(F.array(F.lit(0.0)), "_b"))
    slopes = fits.groupBy(*by).agg(in_order(fitted).alias("_slopes"))
    means = F.array(*(F.expr(f"{c} / nullif(n, 0)") for c in ("y", *(f"xs[{i}]" for i in range(k)))))
    return slopes, moments.groupBy(*by, group).agg(in_order(means).alias("_levels"))


def ols_residual(df: DataFrame, by: Sequence[str], targets: Sequence[str],
                 exposures: Sequence[str], group: str | None = None,
                 names: dict[str, str] | None = None) -> DataFrame:
    """Residual of each target on [1, exposures, group dummies], fitted per ``by``.

    Missing exposures (null or NaN) take the day's median, then 0. A row with an
    infinite exposure or a target that is not a finite number is left out of the
    fit and gets null. A day with no more usable rows than regressors gives null
    for all of its rows.
    """
    by, targets, names = list(by), list(targets), dict(names or {})
    if len(targets) > WIDE and not names:
        return unpack(residual_cells(pack(df, targets), by, len(targets), exposures, group), targets).select(*df.columns)
    masked = {y: f"_target{i}" for i, y in enumerate(targets)}
    work, filled, usable = _with_exposures(df, by, list(exposures), group)
    work = work.withColumns({masked[y]: F.when(usable, finite(F.col(y))) for y in targets})
    k, ys = len(filled), list(masked.values())
    moments = stored(_co_moments(work, by, "_group", ys, filled), "moments")
    slopes, levels = _regressions(moments, by, "_group", k)
    w = k + 1
    work = attach_arrays(attach_arrays(work, slopes, by, w * len(ys)), levels, [*by, "_group"], w * len(ys))
    # What is centred in its group first leaves an exact 0 for a lone row.
    new = {names.get(y, y): F.expr(f"`{masked[y]}` - _levels[{w * t}] + _slopes[{w * t}]" + "".join(
        f" - _slopes[{w * t + i}] * ({x} - _levels[{w * t + i}])" for i, x in enumerate(filled, 1)))
        for t, y in enumerate(targets)}
    return work.withColumns(new).drop("_group", "_usable", "_slopes", "_levels", *filled, *ys)


def finite(value: Column) -> Column:
    """The value if it is a number; NaN and infinities are null."""
    return F.when(F.abs(value.cast("double")) < F.lit(float("inf")), value)


def _with_exposures(df: DataFrame, by: list[str], exposures: list[str],
                    group: str | None) -> tuple[DataFrame, list[str], Column]:
    """``df`` with ``_group`` and the filled, centred exposures; their names; which rows are usable."""
    filled = [f"_fill{i}" for i in range(len(exposures))]
    infinite = F.lit(False)
    for x in exposures:
        infinite = infinite | F.coalesce(F.abs(F.col(x).cast("double")) == F.lit(float("inf")), F.lit(False))
    work = df.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN_GROUP))
                         if group else F.lit(UNKNOWN_GROUP)).withColumn("_usable", ~infinite)
    if exposures:
        work = work.withColumns({f: finite(F.col(x)) for f, x in zip(filled, exposures, strict=True)})
        medians = quantile_arrays(work, by, filled, (0.5,), "_medians")
        # Taking the median off leaves the residual as it is and keeps sums small.
        work = (attach_arrays(work, medians, by, len(filled))
                .withColumns({f: F.expr(f"coalesce({f} - _medians[{i}], 0D)") for i, f in enumerate(filled)})
                .drop("_medians"))
    return work, filled, F.col("_usable")


def residual_cells(df: DataFrame, by: Sequence[str], n: int, exposures: Sequence[str],
                   group: str | None = None) -> DataFrame:
    """``ols_residual`` of the ``n`` values of the array ``_v``."""
    by = list(by)
    work, filled, usable = _with_exposures(df, by, list(exposures), group)
    work, k = per_cell(work, lambda y: F.when(usable, finite(y))), len(filled)
    moments = stored(_co_moments(work, by, "_group", None, filled), "moments")
    slopes, levels = _regressions(moments, by, "_group", k)
    w = k + 1
    work = attach_arrays(attach_arrays(work, slopes, by, w * n), levels, [*by, "_group"], w * n)

    def rest(y: Column, t: Column) -> Column:
        out = y - F.get("_levels", w * t) + F.get("_slopes", w * t)
        for i, x in enumerate(filled, 1):
            out = out - F.get("_slopes", w * t + i) * (F.col(x) - F.get("_levels", w * t + i))
        return out

    return per_cell(work, rest).drop("_group", "_usable", "_slopes", "_levels", *filled)


#: Targets whose regressions are worked on at once.
HELD_TARGETS = 32


def residual_held(df: DataFrame, by: Sequence[str], exposures: Sequence[str], group: str | None = None) -> DataFrame:
    """``ols_residual`` of the values of the array ``_v`` where every ``by`` fits a task; stored."""
    work, filled, usable = _with_exposures(df, list(by), list(exposures), group)
    k, solved = len(filled), solver()

    def rest(values, missing, table):
        codes = table.column("_group").combine_chunks().dictionary_encode().indices.to_numpy()
        rows = np.argsort(codes, kind="stable")
        codes = codes[rows]
        first = np.r_[True, codes[1:] != codes[:-1]]
        starts, runs = np.flatnonzero(first), np.cumsum(first) - 1
        xs = [table.column(c).to_numpy().astype(float)[rows, None] for c in filled]
        out, gone = np.empty_like(values), np.ones_like(missing)
        # A lone infinity or NaN is no number to fit, nor is any target of a row that is not usable.
        gone[rows] = (missing | ~np.isfinite(values) | ~table.column("_usable").to_numpy()[:, None])[rows]
        for at in range(0, values.shape[1], HELD_TARGETS):
            own = slice(at, at + HELD_TARGETS)
            kept = (~gone[:, own])[rows].astype(float)
            y = np.where(kept > 0, values[:, own][rows], 0.0)

            def sums(cells):
                return np.add.reduceat(cells, starts, axis=0)

            n = sums(kept)
            least = np.maximum(n, 1.0)
            ys, parts = sums(y), [sums(kept * x) for x in xs]
            matrix, vector = np.zeros((y.shape[1], k, k)), np.zeros((y.shape[1], k))
            for i, x in enumerate(xs):
                vector[:, i] = (sums(x * y) - parts[i] * ys / least).sum(axis=0)
                for j in range(i, k):
                    matrix[:, i, j] = matrix[:, j, i] = (
                        sums(kept * x * xs[j]) - parts[i] * parts[j] / least).sum(axis=0)
            slopes = np.array([solved(m, v) for m, v in zip(matrix, vector, strict=True)]) if k else vector
            found = y - (ys / least)[runs]
            for i, x in enumerate(xs):
                found -= slopes[:, i] * (x - (parts[i] / least)[runs])
            out[rows, own] = found
            gone[:, own] |= n.sum(axis=0) <= k + len(starts)
        return out, gone

    work = work.withColumn("_usable", usable)
    return stored(per_group(work, by, rest).drop("_group", "_usable", *filled), "residuals")
