"""Exact ranks and quantiles per group that never gather an unbounded group.

The largest group is counted first. While it is small enough for one task, its
rows are ranked there in one go, and quantiles come from ``percentile``. A larger one (one date may hold much of
a panel) is spread out: ranks come from one range sort over (group, value,
entity), in which a group spans many slices; quantiles come from two scans, a
sketch that brackets each wanted position and counts that settle its value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions.lookup import attach, null_safe_join
from paneltide.functions.wide import attach_arrays, gather, item, packs
from paneltide.session import settle, stored

GROUP_CONF = "paneltide.group.maxRows"
GROUP_ROWS = 1_000_000
#: Rows of a task that ranks whole groups, on average.
TASK_ROWS = 250_000
SKETCH_ACCURACY = 10_000
CELLS_PER_PASS = 2_000_000
#: Rows of a block whose shifts one task takes.
SHIFT_ROWS = 200_000
#: Columns whose quantiles are taken in one pass, at most.
MOST_COLUMNS = 200


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group, by a count of the keys alone."""
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(GROUP_CONF, str(GROUP_ROWS)))


def groups_are_small(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether every group fits one task, by a measured count."""
    return group_tasks(df, by) > 0


def group_tasks(df: DataFrame, by: Sequence[str]) -> int:
    """Tasks among which the groups are dealt; 0 if one of them does not fit a task.

    They grow with the rows, up to the number for which the shuffle's writers hold no rows back. Beyond it, a
    task that deals rows would hold all of its own, while one that ranks holds a group and sorts by spilling.
    """
    limit = group_limit(df)
    if limit <= 0:
        return 0
    rows, largest = df.groupBy(*by).count().agg(F.sum("count"), F.max("count")).first()
    if (largest or 0) > limit:
        return 0
    most = int(df.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, -(-(rows or 0) // TASK_ROWS)))


def _rank_tools() -> tuple[Callable, ...]:
    """Functions on the rows of one group. They are sent to the tasks by value, for workers that lack this package."""
    def sortable(column: pa.ChunkedArray) -> np.ndarray:
        """Numbers in the order of the values; what stands for nulls is arbitrary."""
        if not (pa.types.is_floating(column.type) or pa.types.is_integer(column.type)):
            column = pc.rank(column, tiebreaker="dense")
        return np.asarray(column.combine_chunks().fill_null(0))

    def run_means(values: np.ndarray) -> np.ndarray:
        """The mean 1-based place of the run of equal values that each sorted value is in."""
        n = len(values)
        if not n:
            return np.zeros(0)
        new = values[1:] != values[:-1]
        if values.dtype.kind == "f":
            new &= ~(np.isnan(values[1:]) & np.isnan(values[:-1]))
        start = np.flatnonzero(np.concatenate(([True], new)))
        ends = np.append(start[1:], n)
        return np.repeat((start + 1 + ends) / 2, ends - start)

    def in_order(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The given rows, which are in the order of the entity, sorted by their keys."""
        return rows[np.argsort(keys[rows], kind="stable")]

    def filled(n: int, at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        """An array of ``n`` places with the values at the given ones, else null."""
        out, absent = np.zeros(n, values.dtype), np.ones(n, bool)
        out[at], absent[at] = values, False
        return pa.array(out, kind, mask=absent)

    def by_entity(group: pa.Table, entity: str) -> np.ndarray:
        return np.asarray(pc.sort_indices(group, sort_keys=[(entity, "ascending")], null_placement="at_start"))

    return sortable, run_means, in_order, filled, by_entity


def _per_group(df: DataFrame, by: list[str], tasks: int, add: Callable[[pa.Table], dict], new: dict[str, T.DataType]) -> DataFrame:
    """``df`` with the columns that ``add`` finds for the rows of a group; groups fit a task.

    The rows of a task are sorted once, by group; there are more tasks if there are more rows.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in new.items())])

    def widen(group: pa.Table) -> pa.Table:
        for name, column in add(group).items():
            group = group.append_column(name, column)
        return group

    return df.repartition(tasks, *by).groupBy(*by).applyInArrow(widen, schema)


def _task_rank(df: DataFrame, by: list[str], value: str, entity: str,
               rank: str, count: str, average: str | None, tasks: int) -> DataFrame:
    return _task_ranks(df, by, {value: (rank, count, average)}, entity, tasks)


def _task_ranks(df: DataFrame, by: list[str], names: dict[str, tuple[str, str, str | None]], entity: str,
                tasks: int) -> DataFrame:
    """Ranks of several columns, named (rank, count, average) per column, in one pass over the rows."""
    sortable, run_means, in_order, filled, by_entity = _rank_tools()

    def add(group: pa.Table) -> dict:
        n, ids, out = len(group), by_entity(group, entity), {}
        for value, (rank, count, average) in names.items():
            keys, valued = sortable(group[value]), np.asarray(group[value].is_valid())
            rows = in_order(keys, ids[valued[ids]])
            out[count] = pa.array(np.full(n, len(rows), np.int64))
            out[rank] = filled(n, rows, np.arange(1, len(rows) + 1), pa.int64())
            if average:
                out[average] = filled(n, rows, run_means(keys[rows]), pa.float64())
        return out

    new = {}
    for rank, count, average in names.values():
        new |= {count: T.LongType(), rank: T.LongType(), **({average: T.DoubleType()} if average else {})}
    return _per_group(df, by, tasks, add, new)


def _spread_rank(df: DataFrame, by: list[str], value: str, entity: str,
                 rank: str, count: str) -> DataFrame:
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c) for c in by), F.col(value).asc_nulls_first(), F.col(entity)]
    # The row id counts up inside a slice; both are stored with the rows.
    cut = settle(df.repartitionByRange(slices, *keys).sortWithinPartitions(*keys)
                 .withColumn("_slice", F.spark_partition_id())
                 .withColumn("_row", F.monotonically_increasing_id()))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and slice, so these windows are small.
    starts = (cut.groupBy(*by, "_slice")
              .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"),
                   F.count(value).alias("_valued"))
              .select(*by, "_slice",
                      (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
                       - F.sum(F.col("_rows") - F.col("_valued")).over(group)).alias("_shift"),
                      F.sum("_valued").over(group).alias(count)))
    return (attach(cut, starts, [*by, "_slice"])
            .withColumn(rank, F.when(F.col(value).isNotNull(), F.col("_row") + F.col("_shift")))
            .drop("_slice", "_row", "_shift"))


def ordinal_rank(df: DataFrame, by: Sequence[str], value: str, entity: str,
                 rank: str = "_rank", count: str = "_count",
                 small: int | None = None) -> DataFrame:
    """Add the 1-based rank of ``value`` in its group and the group's non-null count.

    Ties are broken by ``entity``; a null value has a null rank. ``small`` passes
    on what ``group_tasks`` found for these groups or larger ones.
    """
    by = list(by)
    if tasks := group_tasks(df, by) if small is None else small:
        return _task_rank(df, by, value, entity, rank, count, None, tasks)
    return _spread_rank(df, by, value, entity, rank, count)


def average_rank(df: DataFrame, by: Sequence[str], value: str, entity: str,
                 average: str = "_avg_rank", rank: str = "_rank",
                 count: str = "_count", small: int | None = None) -> DataFrame:
    """``ordinal_rank`` plus the mean rank of all rows that share the value."""
    by = list(by)
    if tasks := group_tasks(df, by) if small is None else small:
        return _task_rank(df, by, value, entity, rank, count, average, tasks)
    ranked = _spread_rank(df, by, value, entity, rank, count)
    ties = (ranked.filter(F.col(value).isNotNull()).groupBy(*by, value)
            .agg(F.min(rank).alias("_low"), F.max(rank).alias("_high"))
            .filter("_high > _low")
            .select(*by, value, ((F.col("_low") + F.col("_high")) / 2).alias("_tied")))
    return (attach(ranked, ties, [*by, value])
            .withColumn(average, F.coalesce("_tied", F.col(rank).cast("double")))
            .drop("_tied"))


def average_ranks(df: DataFrame, by: Sequence[str], names: dict[str, tuple[str, str, str]], entity: str,
                  small: int | None = None) -> DataFrame:
    """``average_rank`` of several columns, whose (rank, count, average) are named per column.

    Groups that fit a task are shuffled and sorted once for all columns.
    """
    by = list(by)
    if tasks := group_tasks(df, by) if small is None else small:
        return _task_ranks(df, by, names, entity, tasks)
    for value, (rank, count, average) in names.items():
        df = average_rank(df, by, value, entity, average, rank, count, 0)
    return df


def pair_ranks(df: DataFrame, by: Sequence[str], first: str, second: str, entity: str,
               small: int | None = None) -> DataFrame:
    """Ranks of two columns at once, for all groups, in one sort each.

    Adds ``_all``, ``_all_n``: ordinal rank of ``first`` among its values and their number; and among
    rows that have both values (null elsewhere): ``_rank``, ``_n`` (ordinal rank of ``first``, number of
    rows), ``_r1``, ``_r2`` (average ranks). Ordinal ties are broken by ``entity``, which is unique in a
    group. In groups too large for a task, both columns share one range sort, and every slice of it is
    given the counts of all rows and of complete rows before it.
    """
    by = list(by)
    if tasks := group_tasks(df, by) if small is None else small:
        sortable, run_means, in_order, filled, by_entity = _rank_tools()

        def add(group: pa.Table) -> dict:
            n, one, two = len(group), sortable(group[first]), sortable(group[second])
            valued = np.asarray(group[first].is_valid())
            pairs = valued & np.asarray(group[second].is_valid())
            rows = by_entity(group, entity)
            every, other = in_order(one, rows[valued[rows]]), in_order(two, rows[pairs[rows]])
            own = every[pairs[every]]
            return {"_all": filled(n, every, np.arange(1, len(every) + 1), pa.int64()),
                    "_all_n": pa.array(np.full(n, len(every), np.int64)),
                    "_rank": filled(n, own, np.arange(1, len(own) + 1), pa.int64()),
                    "_n": pa.array(np.full(n, len(own), np.int64)),
                    "_r1": filled(n, own, run_means(one[own]), pa.float64()),
                    "_r2": filled(n, other, run_means(two[other]), pa.float64())}

        return _per_group(df, by, tasks, add, {
            **{c: T.LongType() for c in ("_all", "_all_n", "_rank", "_n")}, "_r1": T.DoubleType(), "_r2": T.DoubleType()})
    both = F.col(first).isNotNull() & F.col(second).isNotNull()
    stacked = df.select(*by, entity, both.alias("_both"), F.explode(F.array(*(
        F.struct(F.lit(i).alias("_which"), F.col(c).cast("double").alias("_value")) for i, c in enumerate((first, second))))).alias("_c"))
    stacked = stacked.select(*by, entity, "_both", "_c.*").where("_value IS NOT NULL AND (_which = 0 OR _both)")
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, "_which", "_value", entity]
    cut = stored(stacked.repartitionByRange(slices, *keys).sortWithinPartitions(*keys)
                 .withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = [*by, "_which"]
    earlier = Window.partitionBy(*part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    # One row per group and slice, so these windows are small; the one inside slices is as long as a slice.
    starts = cut.groupBy(*part, "_slice").agg(F.count(F.lit(1)).alias("_rows"), F.count_if("_both").alias("_pairs")).select(
        *part, "_slice", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_rows", "_pairs")),
        *(F.sum(c).over(whole).alias(f"{c}1") for c in ("_rows", "_pairs")))
    run = Window.partitionBy("_slice", *part).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = attach(cut.withColumns({"_i": F.count(F.lit(1)).over(run), "_j": F.count_if("_both").over(run)}),
                    starts, [*part, "_slice"]).withColumns({
                        "_i": F.col("_i") + F.col("_rows0"), "_j": F.col("_j") + F.col("_pairs0")})
    placed = stored(placed.select(*keys, "_both", "_i", "_j", "_rows1", "_pairs1"), "placed")
    tied = (placed.where("_both").groupBy(*part, "_value").agg(((F.min("_j") + F.max("_j")) / 2).alias("_mean")))
    placed = null_safe_join(placed, tied, [*part, "_value"])
    own = F.col("_which") == 0
    found = placed.groupBy(*by, entity).agg(
        F.max(F.when(own, F.col("_i"))).alias("_all"), F.max(F.when(own, F.col("_rows1"))).alias("_all_n"),
        F.max(F.when(own & F.col("_both"), F.col("_j"))).alias("_rank"), F.max(F.when(own, F.col("_pairs1"))).alias("_n"),
        F.max(F.when(own & F.col("_both"), F.col("_mean"))).alias("_r1"),
        F.max(F.when(~own, F.col("_mean"))).alias("_r2"))
    return null_safe_join(df, found, [*by, entity])


def shift_rows(df: DataFrame, by: Sequence[str], order: str, column: str,
               offsets: dict[str, int]) -> DataFrame:
    """Add ``column`` of the row some places later (negative: earlier) in its group.

    ``order`` is unique in a group; a row without it has no place, gets null and
    is not counted. Small groups use a window. Large ones are numbered by a range
    sort and cut into blocks of ``SHIFT_ROWS`` rows; a block is also given the first
    rows of the next one and the last of the one before, as many as the offsets
    reach, so that one sort serves all offsets and no row is joined to another.
    """
    by = list(by)
    if groups_are_small(df, by):
        placed = F.col(order).isNotNull()
        window = Window.partitionBy(*by, placed).orderBy(order)
        return df.withColumns({name: F.when(placed, F.lead(column, n).over(window))
                               for name, n in offsets.items()})
    numbered = _spread_rank(df, by, order, by[0], "_rank", "_count").drop("_count")
    ahead, behind = max([0, *offsets.values()]), max([0, *(-n for n in offsets.values())])
    width = max(SHIFT_ROWS, ahead, behind)
    at, block = (F.col("_rank") - 1) % width, F.floor((F.col("_rank") - 1) / width).cast("long")
    # Rows without a place stay where they are, in blocks of their own.
    home = F.coalesce(block, -1 - F.spark_partition_id().cast("long"))
    dealt = (numbered.withColumn("_home", home)
             .withColumn("_block", F.explode(F.array_compact(F.array(
                 F.col("_home"), F.when(at < ahead, block - 1), F.when(at >= width - behind, block + 1))))))
    window = Window.partitionBy(*by, "_block").orderBy("_rank")
    placed = F.col("_rank").isNotNull()
    moved = dealt.withColumns({n: F.when(placed, F.lead(column, k).over(window)) for n, k in offsets.items()})
    return moved.where("_block = _home").select(*df.columns, *offsets)


def percentile_of(average: str = "_avg_rank", count: str = "_count") -> Column:
    """Average rank scaled to [0, 1]; a lone row gets 0."""
    return (F.col(average) - 1) / F.greatest(F.col(count) - 1, F.lit(1))


def bucket_of(n_groups: int, rank: str = "_rank", count: str = "_count") -> Column:
    """Bucket 0 .. n_groups-1 of the ordinal rank, 0 at the bottom."""
    return F.floor((F.col(rank) - 1) * n_groups / F.col(count)).cast("int")


def quantile_table(df: DataFrame, by: Sequence[str], columns: Sequence[str],
                   fractions: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group.

    Columns are named ``<column>__q<i>`` in the order of ``fractions``.
    """
    packed, n = quantile_arrays(df, by, columns, fractions), len(fractions)
    return packed.select(*by, *(F.get("_quantiles", F.lit(n * k + i)).alias(f"{c}__q{i}")
                                for k, c in enumerate(columns) for i in range(n)))


def quantile_arrays(df: DataFrame, by: Sequence[str], columns: Sequence[str],
                    fractions: Sequence[float], name: str = "_quantiles") -> DataFrame:
    """(group, array) with the quantiles of the first column, then of the second, and so on."""
    by, columns = list(by), list(columns)
    limit = group_limit(df)
    rows = largest_group(df, by) if limit > 0 else 0
    # Values of a group held at once: many columns are taken in several scans,
    # each of which reads only its own columns.
    in_task = 0 < rows <= limit
    held = rows if in_task else 5 * SKETCH_ACCURACY
    width = min(MOST_COLUMNS, max(1, CELLS_PER_PASS // max(held, 1)))
    exact = _task_quantiles if in_task else _spread_quantiles
    parts = []
    for part in packs(columns, width):
        found = exact(df, by, part, fractions)
        cells = F.array(*(f"{c}__q{i}" for c in part for i in range(len(fractions))))
        parts.append((found.select(*by, cells.alias("_part")), len(part) * len(fractions)))
    return gather(parts, by, name)


def _task_quantiles(df: DataFrame, by: list[str], columns: list[str],
                    fractions: Sequence[float]) -> DataFrame:
    wanted = ", ".join(f"{float(f)!r}D" for f in fractions)
    exact = df.groupBy(*by).agg(*(
        F.expr(f"percentile(CAST(`{c}` AS DOUBLE), array({wanted}))").alias(f"_p_{c}")
        for c in columns))
    return exact.select(*by, *(F.expr(f"`_p_{c}`[{i}]").alias(f"{c}__q{i}")
                               for c in columns for i in range(len(fractions))))


def _spread_quantiles(df: DataFrame, by: list[str], columns: Sequence[str],
                      fractions: Sequence[float], accuracy: int = SKETCH_ACCURACY,
                      widen: float = 1.0) -> DataFrame:
    # Bracket half-widths: at least four rows and four sketch errors wide.
    fine, coarse = widen * 4.0 / accuracy, widen * 200.0 / accuracy
    edges = ", ".join(f"{min(max(f + side, 0.0), 1.0):.8f}D" for f in fractions
                      for side in (-fine, fine, -coarse, coarse))
    sketch = df.groupBy(*by).agg(*(F.expr(e) for c in columns for e in (
        f"count(`{c}`) AS `_n_{c}`", f"CAST(min(`{c}`) AS DOUBLE) AS `_l_{c}`",
        f"CAST(max(`{c}`) AS DOUBLE) AS `_h_{c}`",
        f"percentile_approx(CAST(`{c}` AS DOUBLE), array({edges}), {accuracy}) AS `_e_{c}`")))
    near = attach(df.select(*by, *columns), sketch, by)

    def edge(c: str, i: int, high: int) -> str:
        if fine >= 1.0:
            return f"`_{'lh'[high]}_{c}`"
        return (f"CASE WHEN `_n_{c}` > {accuracy} THEN `_e_{c}`[{4 * i + high}] "
                f"WHEN `_n_{c}` > {accuracy // 50} THEN `_e_{c}`[{4 * i + 2 + high}] "
                f"ELSE `_{'lh'[high]}_{c}` END")

    probes = []
    for c in columns:
        value = f"CAST(`{c}` AS DOUBLE)"
        for i, fraction in enumerate(fractions):
            low, high = edge(c, i, 0), edge(c, i, 1)
            inside = f"{value} BETWEEN {low} AND {high}"
            # Rows outside the bracket are only counted, on the thinner side.
            outside = f"{value} < {low}" if fraction <= 0.5 else f"{value} > {high}"
            probes.append(
                f"CASE WHEN {inside} OR {outside} THEN struct('{c}' AS name, {i} AS item, "
                f"{float(fraction)!r}D AS at, `_n_{c}` AS n, "
                f"CASE WHEN {inside} THEN {value} END AS value) END")
    keys = [*by, "name", "item", "at", "n"]
    counts = (near.select(*by, F.expr(f"explode(array_compact(array({', '.join(probes)})))")
                          .alias("p"))
              .select(*by, "p.*").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("rows")))
    # At most a few thousandths of a group lie inside a bracket.
    part = ", ".join(f"`{k}`" for k in keys)
    ends = counts.selectExpr(
        *by, "name", "item", "at", "n", "value", "at * (n - 1) AS spot",
        f"sum(CASE WHEN value IS NULL THEN 0 ELSE rows END) OVER (PARTITION BY {part})"
        " AS inner_rows",
        f"sum(CASE WHEN value IS NULL THEN rows ELSE 0 END) OVER (PARTITION BY {part})"
        " AS outer_rows",
        f"sum(CASE WHEN value IS NULL THEN 0 ELSE rows END) OVER (PARTITION BY {part} "
        "ORDER BY value ASC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run"
    ).selectExpr("*", "CASE WHEN at <= 0.5D THEN outer_rows ELSE n - outer_rows - inner_rows END"
                 " AS below")
    picked = ends.groupBy(*keys, "spot").agg(*map(F.expr, (
        "min(CASE WHEN value IS NOT NULL AND below + run > floor(spot) THEN value END) AS lower",
        "min(CASE WHEN value IS NOT NULL AND below + run > ceil(spot) THEN value END) AS upper",
        "max(below) AS below", "max(below + inner_rows) AS top")))
    values = settle(picked.select(
        *by, "name", "item", F.expr("below > floor(spot) OR top <= ceil(spot)").alias("missed"),
        F.expr("lower + (upper - lower) * (spot - floor(spot))").alias("value")))
    if values.filter("missed").limit(1).count():
        # A sketch was worse than its bound: take wider brackets, in the end all values.
        return _spread_quantiles(df, by, columns, fractions, accuracy, widen * 50)
    return values.groupBy(*by).agg(*(
        F.expr(f"max(CASE WHEN name = '{c}' AND item = {i} THEN value END)").alias(f"{c}__q{i}")
        for c in columns for i in range(len(fractions))))


def clip_to(column: str, low: Column, high: Column) -> Column:
    """Clip to [low, high]; null stays null."""
    return F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), low), high))


def winsorize(df: DataFrame, by: Sequence[str], columns: Sequence[str],
              lower: float = 0.01, upper: float = 0.99,
              names: dict[str, str] | None = None) -> DataFrame:
    """Clip each column to its group's quantiles, in place or under new names."""
    names = names or {}
    bounded = attach_arrays(df, quantile_arrays(df, by, columns, (lower, upper)), by, 2 * len(columns))
    clipped = {names.get(c, c): clip_to(c, item("_quantiles", 2 * k), item("_quantiles", 2 * k + 1))
               for k, c in enumerate(columns)}
    return bounded.withColumns(clipped).drop("_quantiles")
