"""The whole chain: walk-forward fits, stored signals, their evaluation, ensembles, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.operators.ensemble import METHODS, blend
from paneltide.operators.evaluation import COMPARED, SCORE_COLUMNS, compare_models, evaluate_signals
from paneltide.operators.modelling import walk_forward
from paneltide.operators.signals import process_signal_store
from paneltide.session import settle
from paneltide.sources.panel_store import scan_panel
from paneltide.sources.reports import save_tables

#: Tables of a report with a row or a few per model; the others have one per date or row.
SUMMARIES = ("model_summary", "yearly", "exposure_report", "train_log", *(f"compare_{c}" for c in COMPARED))


def run_research(features: DataFrame, labels: DataFrame, returns: DataFrame, exposures: DataFrame | None,
                 config: dict, versions: dict, start: str, end: str, root: str,
                 feature_names: list[str] | None = None, mode: str = "rolling") -> dict[str, str]:
    """Fit, score, process, evaluate and blend; returns the path of every table, by name.

    Below ``root`` are ``models``, ``signals`` (raw), ``processed`` and ``report``. ``returns`` has a
    column for the horizon of every model. ``config`` is that of ``walk_forward`` with ``process``,
    ``evaluate`` (n_groups, quantile, score_columns) and ``ensemble``, a list of configurations of
    ``blend``, each with a ``horizon`` if its method learns. Summaries are stored as CSV, too.
    """
    spark, root = features.sparkSession, root.rstrip("/")
    log = walk_forward(features, labels, config, versions, start, end, f"{root}/models", f"{root}/signals",
                       feature_names, mode)
    process_signal_store(spark, f"{root}/signals", f"{root}/processed", exposures, config.get("process", {}))
    signals = scan_panel(spark, f"{root}/processed")
    own = {"n_groups": 5, "quantile": 0.1, "score_columns": SCORE_COLUMNS, **config.get("evaluate", {})}
    tables = evaluate_signals(signals, returns, exposures, own["n_groups"], own["quantile"], own["score_columns"])
    tables["model_summary"] = settle(tables["model_summary"])
    tables["train_log"] = log
    compared = settle(compare_models(tables["model_summary"]))
    for name in COMPARED:
        tables[f"compare_{name}"] = compared.where(F.col("dimension") == name).drop("dimension")
    for chosen in config.get("ensemble", ({"method": METHODS[1]},)):
        scores, weights = blend(signals, chosen, returns, chosen.get("horizon", 5))
        tables[f"ensemble_{chosen['method']}"] = scores
        if weights is not None:
            tables[f"weights_{chosen['method']}"] = weights
    paths = save_tables(tables, f"{root}/report")
    csv = [name for name in SUMMARIES if name in tables]
    extra = save_tables({name: tables[name] for name in csv}, f"{root}/report/csv", tuple(csv))
    return {**dict(zip(tables, paths, strict=True)), **{f"{n}_csv": p for n, p in zip(csv, extra, strict=True)},
            "signals": f"{root}/signals", "processed": f"{root}/processed"}
