"""Reading and writing panels stored as parquet by year."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneltide.functions.lookup import attach
from paneltide.functions.moments import nan_to_null
from paneltide.session import settle

FACTOR_NAME = re.compile(r"^factor_\d+$")
CATEGORY_NAMES = ("stock_id", "industry")


def _day(value: str | dt.date | None):
    return F.lit(dt.date.fromisoformat(value) if isinstance(value, str) else value)


def scan_panel(spark: SparkSession, path: str, start: str | dt.date | None = None,
               end: str | dt.date | None = None, columns: Sequence[str] | None = None,
               date_col: str = "date", merge_schema: bool = False) -> DataFrame:
    """Rows of a parquet file or folder in the closed date range.

    The date filter and the column list reach the parquet scan; in a folder
    split by ``year`` the bounds also select the directories. ``merge_schema``
    reads every file's footer, for stores whose years differ in columns. NaN is
    read as null.
    """
    try:
        df = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"dataset not found: {path}") from exc
        raise
    by_year = "year" in df.columns and date_col != "year"
    if start is not None:
        df = df.filter(F.col(date_col) >= _day(start))
        df = df.filter(F.col("year") >= F.year(_day(start))) if by_year else df
    if end is not None:
        # A timestamp column counts with its whole last day.
        df = df.filter(F.col(date_col) < F.date_add(_day(end), 1))
        df = df.filter(F.col("year") <= F.year(_day(end))) if by_year else df
    if columns is not None:
        return nan_to_null(df.select(*columns))
    return nan_to_null(df.drop("year") if by_year else df)


def cross_section(spark: SparkSession, path: str, day: str | dt.date,
                  columns: Sequence[str] | None = None, date_col: str = "date") -> DataFrame:
    """The rows of one date; empty if there are none."""
    return scan_panel(spark, path, day, day, columns, date_col)


def calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Distinct dates with their 0-based number in date order.

    The window has one row per calendar date, whatever the size of the panel.
    """
    days = df.select(F.to_date(date_col).alias("date")).filter("date IS NOT NULL").distinct()
    return days.withColumn("day_no", F.row_number().over(Window.orderBy("date")) - 1)


def factor_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if FACTOR_NAME.match(c)]


def category_columns(df: DataFrame) -> list[str]:
    """Known category columns and other string columns that are not factors."""
    return [f.name for f in df.schema if not FACTOR_NAME.match(f.name)
            and (f.name in CATEGORY_NAMES or f.dataType.typeName() == "string")]


def coverage_profile(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Per date: rows, entities, mean null share over the factors, rows kept."""
    factors = factor_columns(df)
    share = sum((F.avg(F.col(c).isNull().cast("int")) for c in factors), F.lit(0.0))
    rows = df.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("stock_id").alias("n_entities"),
        (share / max(len(factors), 1)).alias("null_share"))
    left = kept.groupBy("date").agg(F.count(F.lit(1)).alias("n_kept"))
    return rows.join(left, "date", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))


def enforce_types(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Factors as float, the id as string, the date as date."""
    casts = {c: "float" for c in factors} | {"stock_id": "string", "date": "date"}
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in df.columns})


def keep_last(batches: Sequence[DataFrame], date_col: str = "date",
              extra_keys: Sequence[str] = (), arrival: str | None = None) -> DataFrame:
    """Union by name; of rows with the same key the latest batch's row stays.

    Inside one batch rows have no order of their own: the one with the largest
    ``arrival`` stays, and without that column the one with the largest values, so
    that reruns agree. One aggregation per key, so a row is picked before the
    shuffle too.
    """
    merged = None
    for number, batch in enumerate(batches):
        tagged = batch.withColumn("_turn", F.struct(
            F.lit(number).alias("batch"), (F.col(arrival) if arrival else F.lit(0)).alias("turn")))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    keys = [*extra_keys, date_col, *(["stock_id"] if "stock_id" in merged.columns else [])]
    rest = [c for c in merged.columns if c not in keys and c != "_turn"]
    return (merged.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.struct("_turn", *rest)).alias("_row"))
            .select(*keys, "_row.*").select(*(c for c in merged.columns if c != "_turn")))


def write_by_year(df: DataFrame, root: str, overwrite: bool = False, date_col: str = "date",
                  also_by: Sequence[str] = (), settled: bool = False) -> None:
    """Write under ``year=``; touched years are replaced, or merged with what is there.

    On a merge the new row wins over a stored row with the same key. Untouched
    years are neither read nor written. A row without a date has no year to be
    merged into and is refused. ``settled`` says that ``df`` is a stored table already.
    """
    spark = df.sparkSession
    parts = [*also_by, "year"]
    fresh = df.withColumn("year", F.year(date_col))
    if not overwrite:
        fresh = fresh if settled else settle(fresh)
        years = [r[0] for r in fresh.select("year").distinct().collect()]  # calendar years
        if None in years:
            raise ValueError(f"rows without {date_col} cannot be merged")
        touched = f"{root}{'/*' * len(also_by)}/year={{{','.join(map(str, years))}}}"
        try:
            old = (spark.read.option("basePath", root).option("mergeSchema", "true")
                   .parquet(touched))
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
        else:
            # Directories this batch does not write to are left out.
            old = attach(old, fresh.select(*parts).distinct(), parts, "left_semi")
            # The result is stored before its own source directory is replaced.
            fresh = settle(keep_last([old, fresh], date_col, parts))
    # Ranges end inside a date, so one large date is written by many tasks.
    order = [*parts, date_col, *(["stock_id"] if "stock_id" in df.columns else [])]
    (fresh.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(root))
