"""Ranks and quantiles against pandas, on skewed data and on both plans."""

import numpy as np
import pandas as pd
import pytest

from paneltide.functions import order
from paneltide.functions.order import (average_rank, average_ranks, bucket_of, ordinal_rank, percentile_of,
                                       quantile_table, shift_rows, winsorize)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value is very common, some values are null."""
    rng = np.random.default_rng(5)
    sizes = {"hot": 24_000, "mid": 500, "low": 60, "two": 2, "one": 1}
    rows = []
    for g, n in sizes.items():
        v = rng.normal(100, 1, n).round(3)
        v[rng.random(n) < 0.3] = 100.0
        v[rng.random(n) < 0.05] = np.nan
        rows.append(pd.DataFrame({"g": g, "stock_id": [f"{i:06d}" for i in range(n)], "v": v}))
    rows.append(pd.DataFrame({"g": "void", "stock_id": ["a", "b"], "v": [np.nan, np.nan]}))
    pdf = pd.concat(rows, ignore_index=True)
    from paneltide.functions.moments import nan_to_null
    return pdf, nan_to_null(spark.createDataFrame(pdf)).persist()


def test_average_rank_matches_pandas(skewed, either_path):
    pdf, df = skewed
    out = average_rank(df, ["g"], "v", "stock_id").toPandas().set_index(["g", "stock_id"])
    want = pdf.set_index(["g", "stock_id"])
    want["avg"] = pdf.groupby("g").v.rank().values
    want["n"] = pdf.groupby("g").v.transform("count").values
    both = out.join(want[["avg", "n"]])
    assert len(both) == len(pdf)
    assert both["_avg_rank"].isna().equals(both["avg"].isna())
    assert (both["_avg_rank"] - both["avg"]).abs().max() == 0
    assert (both["_count"] == both["n"]).all()


def test_ordinal_rank_breaks_ties_by_entity(skewed, either_path):
    pdf, df = skewed
    out = ordinal_rank(df, ["g"], "v", "stock_id").toPandas()
    want = pdf.dropna().sort_values(["g", "v", "stock_id"])
    want["r"] = want.groupby("g").cumcount() + 1
    both = want.merge(out, on=["g", "stock_id"])
    assert (both.r == both["_rank"]).all()
    assert out["_rank"].notna().sum() == len(want)


@pytest.mark.parametrize("fractions", [(0.01, 0.5, 0.99), (0.0, 0.25, 1.0)])
def test_quantiles_match_pandas(skewed, either_path, fractions):
    pdf, df = skewed
    out = quantile_table(df, ["g"], ["v"], fractions).toPandas().set_index("g")
    for i, f in enumerate(fractions):
        want = pdf.dropna().groupby("g").v.quantile(f)
        got = out[f"v__q{i}"].reindex(want.index)
        np.testing.assert_allclose(got, want, rtol=1e-12)


def test_winsorize_keeps_nulls(skewed, either_path):
    pdf, df = skewed
    out = winsorize(df, ["g"], ["v"], 0.05, 0.95).toPandas()
    assert out.v.isna().sum() == pdf.v.isna().sum()
    hot, raw = out[out.g == "hot"].v, pdf[pdf.g == "hot"].v
    assert hot.max() == pytest.approx(raw.quantile(0.95))
    assert hot.min() == pytest.approx(raw.quantile(0.05))


def test_lone_row_has_percentile_zero_and_buckets_fill(spark, either_path):
    df = spark.createDataFrame([("a", "x", 5.0)] + [("b", f"{i}", float(i)) for i in range(7)],
                               "g string, stock_id string, v double")
    out = average_rank(df, ["g"], "v", "stock_id").select(
        "g", "stock_id", percentile_of().alias("p"), bucket_of(5).alias("b")).toPandas()
    assert out[out.g == "a"].p.item() == 0
    assert out[out.g == "b"].sort_values("stock_id").b.tolist() == [0, 0, 1, 2, 2, 3, 4]


def test_shifted_rows_match_pandas(skewed, either_path):
    """Also with one entity that holds most rows."""
    pdf, df = skewed
    out = shift_rows(df, ["g"], "stock_id", "v", {"ahead": 3, "behind": -1}).toPandas()
    out = out.set_index(["g", "stock_id"]).sort_index()
    want = pdf.sort_values(["g", "stock_id"]).set_index(["g", "stock_id"])
    for name, n in (("ahead", -3), ("behind", 1)):
        shifted = want.groupby("g").v.shift(n).reindex(out.index)
        assert out[name].isna().equals(shifted.isna())
        assert (out[name] - shifted).abs().max() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_shifts_cross_the_edges_of_blocks(spark, monkeypatch, block):
    """Blocks shorter than an offset, rows without a place and repeated rows; no self-join."""
    monkeypatch.setattr(order, "SHIFT_ROWS", block)
    spark.conf.set("paneltide.group.maxRows", "0")
    try:
        rows = [(g, i if i % 5 else None, float(i)) for g, n in (("a", 41), ("b", 2), (None, 9)) for i in range(n)]
        df = spark.createDataFrame(rows + [("a", None, 0.0)] * 2, "g string, place int, v double")
        out = shift_rows(df, ["g"], "place", "v", {"far": 4, "next": 1, "same": 0, "before": -3})
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert out.columns == ["g", "place", "v", "far", "next", "same", "before"]
        assert plan.count("Join") <= 1 and plan.count("Window [") == 1  # the join gives slices their offset
        got = out.collect()
    finally:
        spark.conf.unset("paneltide.group.maxRows")
    assert len(got) == len(rows) + 2
    for g in ("a", "b", None):
        line = [v for h, place, v in rows if h == g and place is not None]
        for r in (r for r in got if r.g == g):
            for name, n in (("far", 4), ("next", 1), ("same", 0), ("before", -3)):
                to = line.index(r.v) + n if r.place is not None else -1
                assert r[name] == (line[to] if 0 <= to < len(line) else None)


def test_many_columns_are_taken_in_several_scans(skewed, monkeypatch):
    pdf, df = skewed
    wide = df.selectExpr("g", "v AS a", "v * 2 AS b", "v + 1 AS c")
    whole = quantile_table(wide, ["g"], ["a", "b", "c"], (0.5,)).toPandas().set_index("g")
    monkeypatch.setattr(order, "CELLS_PER_PASS", 1)
    split = quantile_table(wide, ["g"], ["a", "b", "c"], (0.5,)).toPandas().set_index("g")
    pd.testing.assert_frame_equal(whole.sort_index(), split.sort_index())


def test_null_groups_and_orders_agree_on_both_paths(spark, either_path):
    rows = [(g, f"{i:03d}", None if i % 7 == 0 else float(i % 5), None if i % 11 == 3 else i)
            for g in (None, "a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, stock_id string, v double, place int")
    got = {(r.g, r.stock_id): r for r in average_rank(df, ["g"], "v", "stock_id").collect()}
    pdf = pd.DataFrame(rows, columns=["g", "stock_id", "v", "place"])
    for g in (None, "a", "b"):
        own = pdf[pdf.g.isna() if g is None else pdf.g == g]
        wanted = own.v.rank()
        for i, name in zip(own.index, own.stock_id):
            r = got[g, name]
            assert r._count == own.v.notna().sum()
            assert (r._avg_rank is None) == np.isnan(wanted[i]) and (r._avg_rank is None or r._avg_rank == wanted[i])
    quantiles = {r.g: r.v__q0 for r in quantile_table(df, ["g"], ["v"], (0.3,)).collect()}
    assert set(quantiles) == {None, "a", "b"}
    assert all(np.isclose(q, np.nanquantile(pdf.v[pdf.g == "a"].astype(float), 0.3)) for q in quantiles.values())
    moved = {(r.g, r.stock_id): (r.next, r.before) for r in shift_rows(
        df, ["g"], "place", "v", {"next": 1, "before": -1}).collect()}
    for g in (None, "a", "b"):
        placed = [r for r in rows if r[0] == g and r[3] is not None]
        for n, r in enumerate(placed):
            later = placed[n + 1][2] if n + 1 < len(placed) else None
            assert moved[g, r[1]] == (later, placed[n - 1][2] if n else None)
        assert all(moved[g, r[1]] == (None, None) for r in rows if r[0] == g and r[3] is None)


def test_missed_bracket_is_widened(spark, monkeypatch):
    """A sketch that is far off costs another scan, not the answer."""
    spark.conf.set("paneltide.group.maxRows", "0")
    try:
        df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": np.arange(3000.0) ** 2}))
        out = order._spread_quantiles(df, ["g"], ["v"], (0.5, 0.99), accuracy=2000, widen=1e-6).first()
    finally:
        spark.conf.unset("paneltide.group.maxRows")
    assert np.allclose([out.v__q0, out.v__q1], np.quantile(np.arange(3000.0) ** 2, (0.5, 0.99)))


def test_pair_ranks_match_pandas(spark, either_path):
    """Both plans, with ties, nulls in either column, a null group and a group without pairs."""
    import numpy as np
    import pandas as pd

    from paneltide.functions.order import pair_ranks

    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][i % 3], f"s{i:03d}", float(rng.integers(0, 9)) if i % 7 else None,
             float(rng.integers(0, 5)) if i % 5 else None) for i in range(150)] + [("c", "s0", 1.0, None), ("c", "s1", None, 2.0)]
    df = spark.createDataFrame(rows, "g string, id string, x double, y double")
    got = pair_ranks(df, ["g"], "x", "y", "id").toPandas().sort_values("id").reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["g", "id", "x", "y"]).sort_values(["id", "g"])
    got = got.sort_values(["id", "g"]).reset_index(drop=True)
    want = []
    for _, part in pdf.groupby("g", dropna=False):
        part = part.sort_values(["x", "id"])
        part["all"] = np.where(part.x.notna(), part.x.notna().cumsum(), np.nan)
        pairs = part.dropna(subset=["x", "y"])
        part["rank"] = pd.Series(range(1, len(pairs) + 1), index=pairs.index, dtype=float)
        part["r1"], part["r2"], part["n"] = pairs.x.rank(), pairs.y.rank(), len(pairs)
        want.append(part)
    want = pd.concat(want).sort_values(["id", "g"]).reset_index(drop=True)
    assert got.id.tolist() == want.id.tolist()
    for mine, theirs in (("_all", "all"), ("_rank", "rank"), ("_r1", "r1"), ("_r2", "r2")):
        np.testing.assert_allclose(got[mine].astype(float), want[theirs].astype(float), equal_nan=True)
    paired = got["_rank"].notna()
    assert (got["_n"][paired] == want.n[paired]).all()


def test_ranks_sort_a_group_once_and_are_dealt_by_rows(skewed, spark, monkeypatch):
    """A task holds a bounded number of rows, however many there are, and sorts them once."""
    pdf, df = skewed
    monkeypatch.setattr(order, "TASK_ROWS", 1000)
    both = df.withColumn("w", df.v.cast("double"))
    for out in (average_rank(df, ["g"], "v", "stock_id"), order.pair_ranks(both, ["g"], "v", "w", "stock_id")):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan
        assert out.rdd.getNumPartitions() == -(-len(pdf) // 1000) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ranks_treat_nan_as_the_largest_value(spark, either_path):
    rows = [("g", f"s{i}", v) for i, v in enumerate([float("nan"), 1.0, None, float("nan"), -0.0, 0.0])]
    out = {r.stock_id: (r["_rank"], r["_avg_rank"], r["_count"]) for r in average_rank(
        spark.createDataFrame(rows, "g string, stock_id string, v double"), ["g"], "v", "stock_id").collect()}
    assert out == {"s0": (4, 4.5, 5), "s1": (3, 3.0, 5), "s2": (None, None, 5), "s3": (5, 4.5, 5),
                   "s4": (1, 1.5, 5), "s5": (2, 1.5, 5)}


def test_ranks_of_several_columns_are_those_of_each(skewed, either_path):
    _, df = skewed
    df = df.selectExpr("*", "-v * v AS w", "CAST(NULL AS DOUBLE) AS x")
    names = {c: (f"r_{c}", f"n_{c}", f"a_{c}") for c in ("v", "w", "x")}
    got = average_ranks(df, ["g"], names, "stock_id").toPandas().set_index(["g", "stock_id"]).sort_index()
    for c, (rank, count, average) in names.items():
        one = average_rank(df, ["g"], c, "stock_id", average, rank, count).toPandas().set_index(["g", "stock_id"]).sort_index()
        pd.testing.assert_frame_equal(got[[rank, count, average]], one[[rank, count, average]])


def test_writers_before_a_ranking_hold_no_rows_back(spark, monkeypatch):
    """More tasks than the shuffle's threshold would make every writer hold its rows in memory."""
    from paneltide.functions import order

    rows = spark.range(3000).selectExpr("id % 700 AS g")
    monkeypatch.setattr(order, "TASK_ROWS", 30)
    assert order.group_tasks(rows, ["g"]) == 100
    monkeypatch.setattr(order, "TASK_ROWS", 3)
    assert order.group_tasks(rows, ["g"]) == 200
