"""The versioned signal table: schema, contract check, writing and reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paneltide.session import stored
from paneltide.sources.panel_store import scan_panel, write_by_year

# Fields of the signal table and the allowed names.
SIGNAL_FIELDS = {
    "date": "date", "stock_id": "string", "model_family": "string", "model_name": "string",
    "model_version": "string", "feature_version": "string", "label_version": "string",
    "label_type": "string", "horizon": "int", "objective_type": "string", "raw_score": "double",
    "window_id": "string", "train_start": "date", "train_end": "date", "valid_start": "date",
    "valid_end": "date", "test_start": "date", "test_end": "date", "ic_valid": "double",
    "rankic_valid": "double", "icir_valid": "double", "best_iteration": "int",
    "created_time": "timestamp",
}
FAMILIES = ["lightgbm", "xgboost", "catboost", "gbt", "forest", "linear"]
OBJECTIVES = ["regression", "ranking", "classification"]
LABEL_TYPES = ["raw_return", "excess_return", "industry_neutral_return", "residual_return",
               "rank_return", "group_label"]
HORIZONS = [1, 5, 10, 20]
VERSIONS = ["model_version", "feature_version", "label_version"]
SIGNAL_KEY = ["date", "stock_id", "model_name", "model_version"]


def signal_frame(predictions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Predictions (date, stock_id, raw_score) with the constants of one run.

    ``metadata`` has exactly one row; a join of several runs would need their keys.
    """
    constants = [c for c in SIGNAL_FIELDS
                 if c not in ("date", "stock_id", "raw_score", "created_time")]
    absent = set(constants) - set(metadata.columns)
    if absent:
        raise ValueError(f"run metadata lacks {sorted(absent)}")
    if metadata.limit(2).count() != 1:
        raise ValueError("run metadata must have exactly one row")
    rows = predictions.select("date", "stock_id", "raw_score").crossJoin(
        F.broadcast(metadata.select(*constants)))
    rows = rows.withColumn("created_time", F.current_timestamp())
    return rows.select(*(F.col(c).cast(t).alias(c) for c, t in SIGNAL_FIELDS.items()))


def _row_rules(df: DataFrame) -> dict[str, Column]:
    """The rules a row can break by itself, as conditions that hold for bad rows."""
    absent = [c for c in SIGNAL_FIELDS if c not in df.columns]
    if absent:
        raise ValueError(f"signal frame lacks columns: {absent}")
    allowed = {"model_family": FAMILIES, "objective_type": OBJECTIVES, "label_type": LABEL_TYPES,
               "horizon": HORIZONS}
    rules = {f"empty_{c}": F.col(c).isNull() | (F.col(c) == "") for c in VERSIONS}
    return rules | {f"bad_{c}": ~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in allowed.items()}


def contract_violations(df: DataFrame) -> DataFrame:
    """Rows breaking each rule of the signal table: (rule, n_bad).

    One scan: bad rows are counted per key, partly before the shuffle, then summed.
    """
    rules = _row_rules(df)
    by_key = df.groupBy(*SIGNAL_KEY).agg(
        *(F.count_if(bad).alias(rule) for rule, bad in rules.items()),
        (F.count(F.lit(1)) - 1).alias("duplicate_key"))
    names = [*rules, "duplicate_key"]
    totals = by_key.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names))
    return totals.unpivot([], names, "rule", "n_bad")


def _refuse(counts: dict[str, int]) -> None:
    broken = [f"{rule}={n}" for rule, n in counts.items() if n]
    if broken:
        raise ValueError("signal contract broken: " + ", ".join(broken))


def check_contract(df: DataFrame) -> None:
    _refuse({r["rule"]: r["n_bad"] for r in contract_violations(df).collect()})  # eight rows


def write_signals(df: DataFrame, root: str) -> None:
    """Merge into the store by model and year, if no row breaks the contract.

    The batch is written once, to a staged table; what its rows break is counted on the way. Repeated
    keys are counted from the key columns of the staged table, which is then what is merged. A batch
    that breaks a rule leaves the store as it was.
    """
    rules, seen = _row_rules(df), Observation()
    staged = stored(df.observe(seen, *(F.count_if(bad).alias(rule) for rule, bad in rules.items())), "staged")
    _refuse({rule: seen.get[rule] for rule in rules})
    repeated = staged.groupBy(*SIGNAL_KEY).count().where("count > 1").agg(F.sum(F.col("count") - 1)).first()[0]
    _refuse({"duplicate_key": repeated or 0})
    write_by_year(staged, root, also_by=["model_name"], settled=True)


def read_signals(spark: SparkSession, root: str, model_name: str | None = None,
                 start: str | None = None, end: str | None = None,
                 columns: list[str] | None = None) -> DataFrame:
    """Rows of one model or all, in a date range; only the needed directories are read."""
    df = scan_panel(spark, root, start, end)
    if model_name is not None:
        df = df.filter(F.col("model_name") == model_name)
    return df.select(*columns) if columns else df
