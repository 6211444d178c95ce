"""Joining a large table to per-group results without moving it needlessly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.session import counted

BROADCAST_CONF = "paneltide.broadcast.maxBytes"
BROADCAST_BYTES = 64 * 1024 * 1024


def _row_bytes(schema: T.StructType) -> int:
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    return 16 + sum(8 if isinstance(f.dataType, fixed) else 64 for f in schema)


def null_safe_join(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equally named keys, where a null key equals a null key."""
    own = {c: f"_key_{i}" for i, c in enumerate(on)}
    same = F.lit(True)
    for name, renamed in own.items():
        same = same & F.col(name).eqNullSafe(F.col(renamed))
    joined = df.join(table.withColumnsRenamed(own), same, how)
    if how == "full":
        joined = joined.withColumns({c: F.coalesce(c, k) for c, k in own.items()})
    return joined.drop(*own.values())


def join_rows(df: DataFrame, rows: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both have a row per entity and date.

    Both grow with the panel, so neither is broadcast: the size of the files, by which Spark would choose,
    is a small part of what the rows take in the memory of every executor.
    """
    return df.join(rows.hint("merge"), list(on), how)


def attach(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
           settled: bool = False) -> DataFrame:
    """Join ``table`` to ``df`` on equally named keys, null to null.

    ``table`` is written first and its rows are counted on the way. Within the
    limit it is broadcast and ``df`` is not shuffled; beyond it both sides are
    shuffled on the keys and adaptive execution splits hot ones.
    """
    kept, rows = (table, table.count()) if settled else counted(table, "lookup")
    limit = int(df.sparkSession.conf.get(BROADCAST_CONF, str(BROADCAST_BYTES)))
    fits = rows * _row_bytes(kept.schema) <= limit
    return null_safe_join(df, F.broadcast(kept) if fits else kept, on, how)
