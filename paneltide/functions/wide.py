"""Per-group coefficients of many columns, packed in arrays and joined once.

A wide panel has a thousand factors. Their coefficients end in one table (group, array), which is
joined to the panel a single time, so the joins of a step do not grow with the number of columns
and the panel is not shuffled. Beyond ``WIDE`` columns, the factors of a row are one array ``_v``
while they are worked on: a step is one expression over that array, and statistics are taken over
its exploded cells, so that neither plans nor generated code grow with the columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions.lookup import BROADCAST_BYTES, BROADCAST_CONF, null_safe_join
from paneltide.session import counted

#: Columns above which a panel is wide, and columns whose moments are taken in one pass below it.
WIDE = 24
PACK_COLUMNS = 50
#: Cells of a part of a dealt panel.
TASK_CELLS = 1_000_000
#: Most slices of dates in which a panel is joined; beyond it, the join is left to a shuffle.
MOST_SLICES = 64


def packs(columns: Sequence[str], width: int | None = None) -> list[list[str]]:
    width = width or PACK_COLUMNS
    return [list(columns[i:i + width]) for i in range(0, len(columns), width)]


def gather(parts: Sequence[tuple[DataFrame, int]], by: Sequence[str], name: str) -> DataFrame:
    """One row per group: the arrays ``_part`` of all parts one after another.

    ``parts`` are tables (group, _part) with the arrays' size; a group that a part lacks has nulls.
    """
    by = list(by)
    if len(parts) == 1:
        return parts[0][0].withColumnRenamed("_part", name)
    rows = reduce(DataFrame.unionByName, [
        part.select(*by, F.lit(i).alias("_no"), "_part") for i, (part, _) in enumerate(parts)])
    one = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_no", "_part"))).alias("_all"))
    filled = [F.coalesce(F.try_element_at("_all", F.lit(i)), F.array_repeat(F.lit(None).cast("double"), size))
              for i, (_, size) in enumerate(parts)]
    return one.select(*by, F.concat(*filled).alias(name))


def aggregates(df: DataFrame, by: Sequence[str], columns: Sequence[str], exprs: Sequence[str],
               name: str) -> DataFrame:
    """Gathered results of the expressions, which name the column ``{0}``, column by column."""
    parts = []
    for part in packs(columns):
        cells = F.array(*(F.expr(e.format(f"`{c}`")).cast("double") for c in part for e in exprs))
        parts.append((df.groupBy(*by).agg(cells.alias("_part")), len(part) * len(exprs)))
    return gather(parts, by, name)


def attach_arrays(df: DataFrame, table: DataFrame, on: Sequence[str], width: int) -> DataFrame:
    """Left join of a gathered table with ``width`` numbers per row; ``df`` is not shuffled.

    The table is stored and its size taken. If it is too large to be broadcast, the dates are cut
    into slices whose rows of the table are small enough; each slice of ``df`` is joined with its own,
    and reads only its dates. A table that even ``MOST_SLICES`` do not make small is joined by a shuffle.
    """
    on, spark = list(on), df.sparkSession
    kept, rows = counted(table, "coefficients")
    limit = int(spark.conf.get(BROADCAST_CONF, str(BROADCAST_BYTES)))
    row_bytes = 64 + 64 * len(on) + 8 * width
    if rows * row_bytes <= limit:
        return null_safe_join(df, F.broadcast(kept), on)
    if "date" not in on or rows * row_bytes > limit * MOST_SLICES:
        return null_safe_join(df, kept, on)
    # One row per date: the dates at which the slices end.
    counts = kept.groupBy("date").count().orderBy("date").collect()
    ends, held = [], 0
    for row in counts:
        if row["date"] is None:
            continue
        if held and (held + row["count"]) * row_bytes > limit:
            ends.append(row["date"])
            held = 0
        held += row["count"]
    if len(ends) >= MOST_SLICES or max(r["count"] for r in counts) * row_bytes > limit:
        return null_safe_join(df, kept, on)
    day = F.col("date")
    inside = [(day >= F.lit(a)) & (day < F.lit(b)) for a, b in zip(ends[:-1], ends[1:])]
    inside = [day < F.lit(ends[0]), *inside, day >= F.lit(ends[-1])] if ends else [day.isNotNull()]
    parts = [null_safe_join(df.filter(where), F.broadcast(kept.filter(where)), on) for where in inside]
    parts.append(null_safe_join(df.filter(day.isNull()), F.broadcast(kept.filter(day.isNull())), on))
    return reduce(DataFrame.unionByName, parts)


def dealt(df: DataFrame, by: Sequence[str], width: int, whole: bool = False) -> DataFrame:
    """A stored table in parts of about ``TASK_CELLS`` cells, ``width`` a row, in the order of ``by``.

    A group may span parts, unless it is asked for ``whole``; the number of parts follows the rows. Whole
    groups are dealt among no more parts than for which the shuffle's writers hold no rows back.
    """
    parts = max(1, -(-df.count() * width // TASK_CELLS))
    if not whole:
        return df.repartitionByRange(parts, *by, F.rand(7))
    most = int(df.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return df.repartition(min(parts, most), *by)


def held_whole(df: DataFrame, by: Sequence[str], width: int, limit: int) -> bool:
    """Whether every group, ``width`` numbers a row, is small enough to be worked on in one task.

    The bound is the one for tables that are sent to every task; ``limit`` is the most rows of a group.
    """
    rows = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    most = int(df.sparkSession.conf.get(BROADCAST_CONF, str(BROADCAST_BYTES)))
    return rows <= limit and rows * (64 + 64 * len(by) + 8 * width) <= most


def per_group(df: DataFrame, by: Sequence[str], change) -> DataFrame:
    """Replace the values of ``_v`` group by group, each in one task.

    ``change(values, missing, table)`` gets a group's values as a matrix, a row for each row of the group's
    Arrow ``table``, with a NaN where the equal matrix ``missing`` is true; it returns the new pair.
    """
    def changed(table: pa.Table) -> pa.Table:
        at = table.schema.get_field_index("_v")
        lists = table.column(at).combine_chunks()
        flat = lists.flatten()
        shape = (table.num_rows, len(flat) // max(1, table.num_rows))
        values = np.array(flat.to_numpy(zero_copy_only=False), float).reshape(shape)
        missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(shape)
        values, missing = change(values, missing, table)
        cells = pa.array(np.ascontiguousarray(values).reshape(-1), pa.float64(), mask=np.ascontiguousarray(missing).reshape(-1))
        offsets = pa.array(np.arange(shape[0] + 1, dtype=np.int32) * np.int32(shape[1]))
        # Values that were never null may be so now.
        kind = pa.list_(pa.field("element", pa.float64()))
        return table.set_column(at, pa.field("_v", kind), pa.ListArray.from_arrays(offsets, cells, type=kind))

    schema = T.StructType([T.StructField("_v", T.ArrayType(T.DoubleType())) if f.name == "_v" else f for f in df.schema])
    return df.groupBy(*by).applyInArrow(changed, schema)


def column_quantiles() -> Callable:
    """A function for the interpolated quantiles of the values of each column; NaN for a column without any.

    It is sent to the tasks by value, for workers that lack this package.
    """
    def quantiles(values: np.ndarray, missing: np.ndarray, fractions: Sequence[float]) -> list[np.ndarray]:
        ordered, n = np.sort(np.where(missing, np.nan, values), axis=0), (~missing).sum(axis=0)
        column, out = np.arange(values.shape[1]), []
        for fraction in fractions:
            spot = fraction * np.maximum(n - 1, 0)
            low, high = np.floor(spot).astype(int), np.ceil(spot).astype(int)
            a, b = ordered[low, column], ordered[high, column]
            with np.errstate(invalid="ignore"):
                out.append(np.where((low == high) | (a == b), a, (high - spot) * a + (spot - low) * b))
        return out

    return quantiles


def item(name: str, at: int) -> Column:
    return F.get(F.col(name), F.lit(at))


def pack(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the columns as one array ``_v``."""
    keep = [F.col(c) for c in df.columns if c not in set(columns)]
    return df.select(*keep, F.array(*(F.col(c).cast("double") for c in columns)).alias("_v"))


def unpack(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the array ``_v`` as columns again."""
    return df.select(*(c for c in df.columns if c != "_v"), *(item("_v", i).alias(c) for i, c in enumerate(columns)))


def per_cell(df: DataFrame, change) -> DataFrame:
    """Replace every value of ``_v`` by ``change(value, place)``."""
    return df.withColumn("_v", F.transform("_v", change))


def cell_aggregates(df: DataFrame, by: Sequence[str], exprs: Sequence[str], name: str) -> DataFrame:
    """(by, array): the expressions over the values ``v`` of each place of ``_v``, place by place."""
    cells = df.select(*by, F.posexplode("_v").alias("_t", "v")).groupBy(*by, "_t").agg(
        F.array(*(F.expr(e).cast("double") for e in exprs)).alias("_part"))
    ordered = F.array_sort(F.collect_list(F.struct("_t", "_part")))
    return cells.groupBy(*by).agg(F.flatten(F.transform(ordered, lambda x: x["_part"])).alias(name))
