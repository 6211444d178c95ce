import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from paneltide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["small groups", "spread groups"])
def either_path(request, spark):
    """Run a test with the plain plan and with the one for unbounded groups."""
    if request.param == "spread groups":
        spark.conf.set("paneltide.group.maxRows", "0")
        spark.conf.set("paneltide.broadcast.maxBytes", "0")
    yield request.param
    spark.conf.unset("paneltide.group.maxRows")
    spark.conf.unset("paneltide.broadcast.maxBytes")


def make_panel(n_days=60, n_stocks=30, seed=3) -> pd.DataFrame:
    """A random panel in which factor_001 drives the return."""
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2020-01-01", periods=n_days).date
    industries = np.array(["tech", "bank", "energy"])
    frames, close = [], np.full(n_stocks, 100.0)
    for day in days:
        alpha = rng.normal(size=n_stocks)
        ret = 0.01 * alpha + rng.normal(scale=0.01, size=n_stocks)
        frames.append(pd.DataFrame({
            "date": day, "stock_id": [f"s{i:03d}" for i in range(n_stocks)],
            "industry": industries[np.arange(n_stocks) % 3], "close": close.copy(),
            "log_mktcap": rng.normal(22, 1, n_stocks), "beta": rng.normal(1, 0.2, n_stocks),
            "turnover": abs(rng.normal(0.02, 0.01, n_stocks)),
            "volatility": abs(rng.normal(0.3, 0.05, n_stocks)),
            "benchmark_weight": 1.0 / n_stocks, "factor_001": alpha,
            "factor_002": np.where(rng.random(n_stocks) < 0.1, np.nan, rng.normal(size=n_stocks)),
            "is_st": (rng.random(n_stocks) < 0.05).astype(int)}))
        close = close * (1 + ret)
    out = pd.concat(frames, ignore_index=True)
    out["return"] = out.groupby("stock_id").close.pct_change()
    return out


@pytest.fixture(scope="session")
def panel_pd():
    return make_panel()


@pytest.fixture(scope="session")
def panel(spark, panel_pd):
    from paneltide.functions.moments import nan_to_null
    return nan_to_null(spark.createDataFrame(panel_pd)).persist()


@pytest.fixture
def day():
    return lambda text: dt.date.fromisoformat(text)
