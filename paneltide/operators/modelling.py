"""Walk-forward fitting and scoring with Spark MLlib.

The driver starts fits side by side for windows and model specs; every fit, score
and metric is a Spark job over rows that are stored once for all windows.
"""

from __future__ import annotations

import math
import random
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from concurrent.futures import TimeoutError as FutureTimeout
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression,
                                   LinearRegressionModel, RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.operators.evaluation import daily_results, ic_summary
from paneltide.operators.labels import drop_unlabelled, label_column
from paneltide.operators.splits import (WINDOW_FIELDS, expanding_windows, rolling_windows,
                                        split_dates)
from paneltide.session import settle, stored
from paneltide.sources.panel_store import calendar, factor_columns
from paneltide.sources.signal_store import signal_frame, write_signals

ESTIMATORS = {"gbt": GBTRegressor, "forest": RandomForestRegressor, "linear": LinearRegression}
LOADERS = {"gbt": GBTRegressionModel, "forest": RandomForestRegressionModel,
           "linear": LinearRegressionModel}
DEFAULTS = {
    "gbt": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.7,
            "minInstancesPerNode": 20},
    "forest": {"numTrees": 50, "maxDepth": 5, "subsamplingRate": 0.7, "minInstancesPerNode": 20},
    "linear": {"regParam": 0.0},
}
# Short names used in a model's name.
OBJECTIVE_SHORT = {"regression": "reg", "ranking": "rank", "classification": "cls"}
LABEL_SHORT = {
    "raw_return": "raw", "excess_return": "excess", "industry_neutral_return": "indneu",
    "residual_return": "residual", "rank_return": "rankret", "group_label": "group",
}
FAMILY_SHORT = {"lightgbm": "lgbm", "xgboost": "xgb", "catboost": "cat"}
PARAM_TYPES = ("int", "float", "categorical")


def model_name(family: str, objective: str, label_type: str, horizon: int, version: str) -> str:
    version = version if version.startswith("v") else f"v{version}"
    return "_".join([FAMILY_SHORT.get(family, family), OBJECTIVE_SHORT[objective],
                     LABEL_SHORT[label_type], f"h{horizon}", version])


#: What a model fits and what its scores are measured with, where it is not the label itself.
FITTED = {"ranking": "group_label"}
MEASURED = {"rank_return": "excess_return", "group_label": "excess_return"}


def training_labels(objective: str, label_type: str, horizon: int) -> tuple[str, str]:
    """Label to fit and continuous label to measure with.

    Ranking is fitted pointwise on the bucket label; ranks and buckets are
    measured against the excess return.
    """
    chosen = (FITTED.get(objective, label_type), MEASURED.get(label_type, label_type))
    return tuple(label_column(label, horizon) for label in chosen)


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector; a missing standardized factor counts as its mean, 0."""
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                             for c in features})
    vector = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_features")
    return vector.transform(filled).drop(*(f"_f_{c}" for c in features))


def fit(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str,
        family: str = "gbt", params: dict | None = None, seed: int = 42):
    """Fit one model; boosting stops early on the validation rows."""
    if family not in ESTIMATORS:
        raise ValueError(f"unknown model family: {family}; expect {sorted(ESTIMATORS)}")
    options = {**DEFAULTS[family], **(params or {}), "featuresCol": "_features",
               "labelCol": "_label"}
    rows = train.withColumn("_valid", F.lit(False))
    if family == "gbt":
        rows = rows.unionByName(valid.withColumn("_valid", F.lit(True)))
        options["validationIndicatorCol"] = "_valid"
    if family != "linear":
        options["seed"] = seed
    rows = drop_unlabelled(rows, label).withColumn("_label", F.col(label).cast("double"))
    return ESTIMATORS[family](**options).fit(
        _assemble(rows, features).select("_features", "_label", "_valid"))


def predict(model, rows: DataFrame, features: Sequence[str],
            keep: Sequence[str] = ("date", "stock_id")) -> DataFrame:
    """One raw score per row."""
    scored = model.transform(_assemble(rows, features))
    return scored.select(*keep, F.col("prediction").alias("raw_score"))


def validation_metrics(scored: DataFrame, label: str, score: str = "raw_score",
                       series: Sequence[str] = ()) -> DataFrame:
    """Mean and information ratio of daily correlation and rank correlation."""
    # One prediction and one ranking pass serve both.
    daily = settle(daily_results(scored, score, label, None, series))
    plain = ic_summary(daily, "ic", series).select(
        *series, F.col("ic_mean").alias("ic_valid"), F.col("icir").alias("icir_valid"))
    ranks = ic_summary(daily, "rank_ic", series).select(
        *series, F.col("ic_mean").alias("rankic_valid"), F.col("icir").alias("rankicir_valid"))
    return plain.join(ranks, list(series)) if series else plain.crossJoin(ranks)


def rounds(model) -> int:
    """Trees kept, or iterations of the linear solver."""
    if hasattr(model, "getNumTrees"):
        return int(model.getNumTrees)
    return int(model.summary.totalIterations) if model.hasSummary else 0


def feature_importance(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """(feature, importance), largest first; absolute coefficients for linear models."""
    values = (model.featureImportances if hasattr(model, "featureImportances")
              else [abs(c) for c in model.coefficients])
    rows = [(f, float(values[i])) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def run_window(rows: DataFrame, features: Sequence[str], label: str, measured: str | None = None,
               family: str = "gbt", params: dict | None = None, seed: int = 42) -> dict:
    """Fit on train, measure on valid, score test. ``rows`` carries ``split``."""
    part = {s: rows.filter(F.col("split") == s) for s in ("train", "valid", "test")}
    model = fit(part["train"], part["valid"], features, label, family, params, seed)
    measured = measured or label
    scored = predict(model, part["valid"], features, ("date", "stock_id", measured))
    metrics = validation_metrics(scored, measured).first().asDict()
    return {"model": model, "best_iteration": rounds(model), **metrics,
            "predictions": predict(model, part["test"], features),
            "importance": feature_importance(rows.sparkSession, model, features)}


def save_model(result: dict, metadata: DataFrame, root: str) -> None:
    """Model, metadata and feature importance under one folder."""
    result["model"].write().overwrite().save(f"{root}/model")
    metadata.write.mode("overwrite").parquet(f"{root}/meta")
    result["importance"].write.mode("overwrite").parquet(f"{root}/importance")


def load_model(family: str, root: str):
    return LOADERS[family].load(f"{root}/model")


def check_space(space: dict[str, dict]) -> dict[str, dict]:
    """Reject search dimensions that are not fully described."""
    for name, dim in space.items():
        kind = dim.get("type")
        if kind not in PARAM_TYPES:
            raise ValueError(f"parameter '{name}' has type {kind!r}; expect one of {PARAM_TYPES}")
        needs = ("choices",) if kind == "categorical" else ("low", "high")
        if any(n not in dim for n in needs):
            raise ValueError(f"parameter '{name}' needs {needs}")
    return space


def _draw(rng: random.Random, dim: dict):
    if dim["type"] == "categorical":
        return rng.choice(dim["choices"])
    low, high = dim["low"], dim["high"]
    if dim.get("log"):
        value = math.exp(rng.uniform(math.log(low), math.log(high)))
    else:
        value = rng.uniform(low, high)
    step = dim.get("step") or (1 if dim["type"] == "int" else None)
    if step:
        value = min(low + round((value - low) / step) * step, high)
    return int(value) if dim["type"] == "int" else float(value)


class Cancelled(Exception):
    """A task's Spark jobs were cancelled at its deadline."""


def side_by_side(spark: SparkSession, tasks: Sequence[tuple[str, Callable]], parallel: int = 4) -> list:
    """Results of (name, function) tasks, at most ``parallel`` at a time, in the order given.

    Every task has its own job group and pool, so under the FAIR scheduler small fits fill the gaps
    that others leave. When a task fails, the jobs of the others are cancelled and its error is raised.
    """
    context, mark = spark.sparkContext, uuid.uuid4().hex

    def start(number: int, name: str, task: Callable):
        context.setJobGroup(f"{mark}-{number}", name, interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", f"fit-{number % parallel}")
        return task()

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(start), i, name, task) for i, (name, task) in enumerate(tasks)]
        done, waiting = wait(futures, return_when=FIRST_EXCEPTION)
        failed = [f for f in done if f.exception()]
        if failed:
            left = [(i, f) for i, f in enumerate(futures) if not f.cancel() and not f.done()]
            while not all(f.done() for _, f in left):  # a task may be between two jobs
                for i, future in left:
                    if not future.done():
                        context.cancelJobGroup(f"{mark}-{i}")
                wait([f for _, f in left], timeout=0.2)
            raise failed[0].exception()
        return [f.result() for f in futures]


def within(spark: SparkSession, name: str, task: Callable, deadline: float | None):
    """The task's result; its jobs are cancelled when the clock reaches ``deadline``."""
    if deadline is None:
        return task()
    context, group = spark.sparkContext, f"{name}-{uuid.uuid4().hex}"

    def start():
        context.setJobGroup(group, name, interruptOnCancel=True)
        return task()

    pool = ThreadPoolExecutor(max_workers=1)
    future = pool.submit(inheritable_thread_target(spark)(start))
    try:
        return future.result(timeout=max(0.0, deadline - time.monotonic()))
    except FutureTimeout:
        # A task may be between two jobs: cancel until it stops.
        while not future.done():
            context.cancelJobGroup(group)
            wait([future], timeout=0.2)
        raise Cancelled(name) from None
    finally:
        pool.shutdown(wait=False)


DIRECTIONS = ("maximize", "minimize")


def search(rows: DataFrame, features: Sequence[str], label: str, space: dict[str, dict],
           measured: str | None = None, family: str = "gbt", base: dict | None = None,
           trials: int = 50, seed: int = 42, timeout: float | None = None,
           direction: str = "maximize", halving: int | None = None) -> tuple[dict, DataFrame]:
    """Seeded random search on train and valid, scored by mean validation RankIC.

    After ``timeout`` seconds the running fit is cancelled and no other starts; the table keeps all
    trials, with ``status`` complete, pruned or timeout. ``direction`` says whether the largest or
    the smallest score wins. With ``halving`` (2 or more) all trials are first fitted on a sample of
    the train dates, the best 1 / ``halving`` of them on a sample that many times larger, and so on
    to all dates; ``rung`` counts these rounds.
    """
    check_space(space)
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}; expect one of {DIRECTIONS}")
    if halving is not None and halving < 2:
        raise ValueError("halving must be 2 or more")
    spark, sign = rows.sparkSession, 1 if direction == "maximize" else -1
    deadline = None if timeout is None else time.monotonic() + timeout
    rng, base, measured = random.Random(seed), dict(base or {}), measured or label
    train, valid = (rows.filter(F.col("split") == s) for s in ("train", "valid"))
    drawn = [{name: _draw(rng, dim) for name, dim in space.items()} for _ in range(trials)]
    last = int(math.log(max(trials, 1), halving) + 1e-9) if halving else 0

    def trial(number: int, sample: DataFrame) -> tuple:
        model = fit(sample, valid, features, label, family, {**base, **drawn[number]}, seed)
        scored = predict(model, valid, features, ("date", "stock_id", measured))
        metrics = validation_metrics(scored, measured).first()
        return (metrics["rankic_valid"], metrics["ic_valid"], metrics["icir_valid"], rounds(model))

    found, alive, late = {}, list(range(trials)), False
    for rung in range(last + 1):
        share = halving ** (last - rung) if halving else 1
        sample = train if share == 1 else train.filter(F.pmod(F.crc32(F.col("date").cast("string").cast("binary")), F.lit(share)) == 0)
        for number in alive:
            if late or deadline is not None and time.monotonic() >= deadline:
                late = True
                break
            try:
                result = within(spark, f"trial {number}", lambda n=number, part=sample: trial(n, part), deadline)
                found[number] = (*result, "complete" if rung == last else "pruned", rung)
            except Cancelled:
                late = True
        if late:
            break
        ranked = sorted(alive, key=lambda n: (found[n][0] is None, -sign * (found[n][0] or 0.0), n))
        alive = ranked[:max(1, len(ranked) // halving)] if halving else ranked
    for number in range(trials):
        if late and number not in found:
            found[number] = (None, None, None, None, "timeout", None)
    # Of the trials that came furthest, the best; without any result, the given parameters.
    scored = [n for n in found if found[n][0] is not None]
    best = min(scored, key=lambda n: (-found[n][5], -sign * found[n][0], n)) if scored else None
    names = sorted(space)
    table = spark.createDataFrame(
        [(n, *found[n], *(str(drawn[n][p]) for p in names)) for n in sorted(found)],
        "trial_number int, rankic_valid double, ic_valid double, icir_valid double, "
        "best_iteration int, status string, rung int" + "".join(f", p_{n} string" for n in names))
    return {**base, **(drawn[best] if best is not None else {})}, table


def fit_windows(rows: DataFrame, windows: DataFrame, dates: DataFrame, features: Sequence[str], label: str,
                measured: str | None = None, family: str = "gbt", params: dict | None = None, seed: int = 42,
                parallel: int = 4) -> list[tuple]:
    """(window row, ``run_window`` result) of every window, fitted side by side.

    ``rows`` are stored labelled rows, ``dates`` are those of ``split_dates``. A window is a filter
    on the stored rows: nothing is copied for it.
    """
    found = windows.orderBy("test_start").collect()  # one small row per window
    tasks = [(w["window_id"], lambda w=w: run_window(rows_of(rows, w, dates), features, label, measured, family,
                                                     params, seed)) for w in found]
    return list(zip(found, side_by_side(rows.sparkSession, tasks, parallel), strict=True))


def rows_of(rows: DataFrame, window, dates: DataFrame) -> DataFrame:
    """The stored rows of a window, with ``split``; only its dates are read."""
    inside = F.col("date").between(F.lit(window["train_start"]), F.lit(window["test_end"]))
    own = dates.filter(F.col("window_id") == window["window_id"]).select("date", "split")
    # One row per date of a window.
    return rows.filter(inside).join(F.broadcast(own), "date")


def walk_forward(features: DataFrame, labels: DataFrame, config: dict, versions: dict,
                 start: str, end: str, models_root: str, signals_root: str,
                 feature_names: Sequence[str] | None = None, mode: str = "rolling") -> DataFrame:
    """Train every spec on every window, store models and signals, return the log.

    The labelled rows are stored once. Fits run side by side (``parallel`` in the config, 4 by
    default), searched parameters come from the first window, and all signals are written together,
    rounded to ``score_digits`` if the config has it.
    """
    spark, seed = features.sparkSession, config.get("seed", 42)
    makers = {"rolling": rolling_windows, "expanding": expanding_windows}
    if mode not in makers:
        raise ValueError(f"unknown train mode: {mode}; expect {sorted(makers)}")
    options = dict(config[mode])
    embargo = options.pop("embargo_days", 20)
    windows = makers[mode](spark, start, end, **options)
    names = list(feature_names or factor_columns(features))
    if not names:
        raise ValueError("no factor columns in the features")
    rows = stored(features.join(labels, ["date", "stock_id"]), "labelled")
    dates = stored(split_dates(windows, calendar(labels), embargo), "dates")
    check_splits(windows, rows, dates)
    tuning, specs = config.get("search", {}), []
    ordered = windows.orderBy("test_start").collect()  # one small row per window
    for spec in config["model_specs"]:
        name = model_name(spec["model_family"], spec["objective_type"], spec["label_type"],
                          spec["horizon"], spec["model_version"])
        family, params = spec["model_family"], spec.get("params")
        label, measured = training_labels(spec["objective_type"], spec["label_type"], spec["horizon"])
        space = tuning.get("search_space", {}).get(family)
        if tuning.get("enabled") and space:
            params, _ = search(rows_of(rows, ordered[0], dates), names, label, space, measured, family, params,
                               tuning.get("n_trials", 50), seed, tuning.get("timeout"),
                               tuning.get("direction", "maximize"), tuning.get("halving"))
        specs.append((spec, name, family, label, measured, params))

    def one(window, spec, name, family, label, measured, params):
        result = run_window(rows_of(rows, window, dates), names, label, measured, family, params, seed)
        meta = {**{k: spec[k] for k in ("model_family", "objective_type", "label_type",
                                        "horizon", "model_version")},
                **versions, "model_name": name, **{f: window[f] for f in WINDOW_FIELDS},
                **{k: result[k] for k in ("ic_valid", "rankic_valid", "icir_valid",
                                          "rankicir_valid", "best_iteration")},
                "params": str(params or {})}
        metadata = spark.createDataFrame([meta], schema=_META_SCHEMA)
        save_model(result, metadata, f"{models_root}/{name}/{window['window_id']}")
        scores = result["predictions"]
        if config.get("score_digits") is not None:
            scores = scores.withColumn("raw_score", F.round("raw_score", config["score_digits"]))
        signals = stored(signal_frame(scores, metadata), "signals")
        return signals, (window["window_id"], name, result["best_iteration"], result["ic_valid"],
                         result["rankic_valid"], result["icir_valid"])

    tasks = [(f"{s[1]} {w['window_id']}", lambda w=w, s=s: one(w, *s)) for w in ordered for s in specs]
    done = side_by_side(spark, tasks, config.get("parallel", 4))
    write_signals(reduce(DataFrame.unionByName, [signals for signals, _ in done]), signals_root)
    return spark.createDataFrame(
        [log for _, log in done], "window_id string, model_name string, best_iteration int, ic_valid double, "
        "rankic_valid double, icir_valid double")


def check_splits(windows: DataFrame, rows: DataFrame, dates: DataFrame) -> None:
    """Raise if a split of a window has no rows; rows are counted per date."""
    per_date = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    found = dates.join(per_date, "date").select("window_id", "split").distinct()
    wanted = windows.select("window_id", F.explode(F.array(*map(F.lit, ("train", "valid", "test")))).alias("split"))
    empty = wanted.join(found, ["window_id", "split"], "left_anti").orderBy("window_id", "split").first()
    if empty:
        raise ValueError(f"window {empty['window_id']}: empty {empty['split']} split")


_META_SCHEMA = ", ".join([
    *(f"{c} string" for c in ("model_family", "objective_type", "label_type")), "horizon int",
    "model_version string", "feature_version string", "label_version string",
    "model_name string", "window_id string",
    *(f"{c} date" for c in WINDOW_FIELDS if c != "window_id"),
    *(f"{c} double" for c in ("ic_valid", "rankic_valid", "icir_valid", "rankicir_valid")),
    "best_iteration int", "params string"])
