"""The registered queries, each with its SQL twin where one can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, so that only real differences show in a comparison."""
    out = []
    for f in df.schema:
        if f.dataType.typeName() in ("double", "float"):
            # Adding 0 turns a negative zero into a plain one.
            out.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def load_all() -> None:
    from paneltide.plans import (queries_backtest, queries_data, queries_labels,  # noqa: F401
                                 queries_model, queries_signal)
