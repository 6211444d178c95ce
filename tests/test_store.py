"""Panel and signal stores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paneltide.operators.preprocess import (fill_missing, preprocess, preprocess_dataset,
                                            reject_lookahead, tradable_universe)
from paneltide.session import scratch_path
from paneltide.sources import panel_store as A
from paneltide.sources import signal_store as S

D = dt.date


def rows(spark, *values):
    return spark.createDataFrame(list(values), "date date, stock_id string, v double")


def test_upsert_keeps_the_last_row_and_other_years(spark):
    root = scratch_path(spark, "p")
    A.write_by_year(rows(spark, (D(2020, 1, 2), "a", 1.0), (D(2021, 1, 4), "a", 2.0),
                         (D(2021, 1, 4), "b", 3.0)), root)
    A.write_by_year(rows(spark, (D(2021, 1, 4), "a", 9.0), (D(2021, 1, 5), "a", 4.0)
                         ).withColumn("extra", F.lit(1)), root)
    got = {(r.date, r.stock_id): (r.v, r.extra) for r in A.scan_panel(spark, root, merge_schema=True).collect()}
    assert got == {(D(2020, 1, 2), "a"): (1.0, None), (D(2021, 1, 4), "a"): (9.0, 1),
                   (D(2021, 1, 4), "b"): (3.0, None), (D(2021, 1, 5), "a"): (4.0, 1)}
    A.write_by_year(rows(spark, (D(2021, 3, 1), "z", 7.0)), root, overwrite=True)
    assert A.scan_panel(spark, root).count() == 2


def test_repeated_key_in_one_batch_keeps_the_later_row(spark):
    batch = rows(spark, (D(2020, 1, 2), "a", 1.0), (D(2020, 1, 2), "a", 2.0)).coalesce(1)
    assert [r.v for r in A.keep_last([batch]).collect()] == [2.0]


def test_scan_prunes_years_and_rejects_missing_paths(spark):
    root = scratch_path(spark, "p")
    A.write_by_year(rows(spark, *((D(y, 6, 1), "a", float(y)) for y in range(2018, 2023))), root)
    df = A.scan_panel(spark, root, "2020-01-01", "2021-12-31", ["date", "v"])
    assert sorted(r.v for r in df.collect()) == [2020.0, 2021.0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(date" in plan
    assert A.cross_section(spark, root, "2020-06-02").count() == 0
    with pytest.raises(FileNotFoundError):
        A.scan_panel(spark, root + "/nowhere")


def test_column_discovery(panel):
    assert A.factor_columns(panel) == ["factor_001", "factor_002"]
    assert A.category_columns(panel) == ["stock_id", "industry"]
    types = dict(A.enforce_types(panel, ["factor_001"]).dtypes)
    assert types["factor_001"] == "float" and types["date"] == "date"


def test_universe_rules(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 0, 1), ("c", None, 0), ("d", 0, 0)],
                               "stock_id string, is_st int, is_limit_up int")
    def kept(**options):
        return sorted(r[0] for r in tradable_universe(df, options).select("stock_id").collect())
    assert kept(drop_st=True) == ["b", "c", "d"]
    assert kept(drop_st=True, drop_limit_up=True, drop_suspended=True) == ["c", "d"]
    assert kept() == ["a", "b", "c", "d"]


def test_features_may_not_look_ahead():
    with pytest.raises(ValueError):
        reject_lookahead(["factor_001", "y_raw_5"])


def test_fill_rejects_unknown_method(panel):
    with pytest.raises(ValueError):
        fill_missing(panel, ["factor_002"], "mode")


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(D(2020, 1, 2), str(i), v) for i, v in
                                enumerate([1.0, 2.0, float("nan"), 3.0])],
                               "date date, stock_id string, factor_001 double")
    out = preprocess(df, ["factor_001"], {"standardize": False, "winsorize":
                                          {"lower": 0.0, "upper": 1.0}}, float32=False)
    assert {r.stock_id: r.factor_001 for r in out.collect()}["2"] == 2.0


def test_other_dates_do_not_matter(panel, panel_pd):
    """Changing one date leaves every other date's cleaned factors as they were."""
    names, last = ["factor_001", "factor_002"], panel_pd.date.max()
    config = {"neutralize": {"enabled": True, "neutral_cols": ["beta", "volatility"]}}
    changed = panel.withColumn("factor_001", F.when(
        F.col("date") == F.lit(last), F.col("factor_001") ** 2).otherwise(F.col("factor_001")))
    first, second = (preprocess(d, names, config, float32=False).select("date", "stock_id", *names)
                     .toPandas().set_index(["date", "stock_id"]).sort_index()
                     for d in (panel, changed))
    same = first.index.get_level_values(0) != last
    assert (first[same] - second[same]).abs().max().max() < 1e-12


def test_preprocess_dataset_fixes_factors_on_the_first_date(spark):
    days = [D(2020, 1, 2), D(2020, 1, 3)]
    data = [(d, str(i), None if d == days[0] else 1.0, float(i)) for d in days for i in range(4)]
    df = spark.createDataFrame(data, "date date, stock_id string, factor_001 double, "
                                     "factor_002 double")
    raw, clean = scratch_path(spark, "raw"), scratch_path(spark, "clean")
    A.write_by_year(df, raw, overwrite=True)
    assert preprocess_dataset(spark, raw, clean, {}) == ["factor_002"]
    out = A.scan_panel(spark, clean)
    assert out.count() == 8 and "factor_001" not in out.columns


META = {"model_family": "gbt", "model_name": "m", "model_version": "v01", "feature_version": "f",
        "label_version": "l", "label_type": "excess_return", "horizon": 5,
        "objective_type": "regression", "window_id": "w", "train_start": "2020-01-01",
        "train_end": "2020-02-01", "valid_start": "2020-02-02", "valid_end": "2020-03-01",
        "test_start": "2020-03-02", "test_end": "2020-04-01", "ic_valid": 0.1,
        "rankic_valid": 0.1, "icir_valid": 0.5, "best_iteration": 3}


def frame(spark, **changes):
    meta = spark.range(1).select(*(F.lit(v).alias(k) for k, v in {**META, **changes}.items()))
    scores = spark.createDataFrame([(D(2020, 3, 2), "a", 1.0), (D(2020, 3, 2), "b", 2.0)],
                                   "date date, stock_id string, raw_score double")
    return S.signal_frame(scores, meta)


def test_signal_frame_and_contract(spark):
    good = frame(spark)
    assert dict(good.dtypes) == S.SIGNAL_FIELDS and good.columns == list(S.SIGNAL_FIELDS)
    S.check_contract(good)
    for broken in (frame(spark, model_version=""), frame(spark, model_family="other"),
                   frame(spark, horizon=7), good.unionByName(good)):
        with pytest.raises(ValueError):
            S.check_contract(broken)
    with pytest.raises(ValueError):
        S.contract_violations(good.drop("label_version"))


def test_signal_store_round_trip(spark):
    root = scratch_path(spark, "s")
    S.write_signals(frame(spark), root)
    S.write_signals(frame(spark, model_name="n"), root)
    S.write_signals(frame(spark).withColumn("raw_score", F.col("raw_score") * 10), root)
    got = S.read_signals(spark, root, "m", "2020-01-01", "2020-12-31", ["stock_id", "raw_score"])
    assert sorted((r[0], r[1]) for r in got.collect()) == [("a", 10.0), ("b", 20.0)]
    assert S.read_signals(spark, root).count() == 4


RULES = {"empty_model_version": ("model_version", ""), "empty_feature_version": ("feature_version", None),
         "empty_label_version": ("label_version", ""), "bad_model_family": ("model_family", None),
         "bad_objective_type": ("objective_type", "other"), "bad_label_type": ("label_type", "y"),
         "bad_horizon": ("horizon", 7)}


def test_every_rule_is_counted_in_one_scan(spark):
    good = frame(spark)
    damaged = good
    for column, value in RULES.values():
        damaged = damaged.unionByName(good.where("stock_id = 'a'").withColumn(
            column, F.lit(value).cast(S.SIGNAL_FIELDS[column])))
    path = scratch_path(spark, "damaged")
    damaged.write.parquet(path)
    counts = S.contract_violations(spark.read.parquet(path))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    # All rows but the changed version have the key of the first one.
    assert {r.rule: r.n_bad for r in counts.collect()} == {**dict.fromkeys(RULES, 1), "duplicate_key": 6}
    assert {r.n_bad for r in S.contract_violations(good.limit(0)).collect()} == {0}


@pytest.mark.parametrize("rule", [*RULES, "duplicate_key"])
def test_a_broken_batch_leaves_the_store_as_it_was(spark, rule):
    root = scratch_path(spark, "s")
    S.write_signals(frame(spark), root)
    late = frame(spark).withColumn("raw_score", F.lit(9.0))
    if rule in RULES:
        column, value = RULES[rule]
        late = late.withColumn(column, F.when(F.col("stock_id") == "b", F.lit(value).cast(
            S.SIGNAL_FIELDS[column])).otherwise(F.col(column)))
    else:
        late = late.unionByName(late.where("stock_id = 'b'"))
    with pytest.raises(ValueError, match=f"{rule}=1$"):
        S.write_signals(late, root)
    assert sorted(r.raw_score for r in S.read_signals(spark, root).collect()) == [1.0, 2.0]


def test_stream_of_deliveries_is_merged(spark):
    from paneltide.streaming.incremental import upsert_stream
    inbox, root, state = (scratch_path(spark, n) for n in ("inbox", "p", "state"))
    rows(spark, (D(2020, 1, 2), "a", 1.0), (D(2020, 1, 2), "b", 2.0)).coalesce(1).write.parquet(inbox)
    for late in (None, (D(2020, 1, 2), "a", 5.0)):
        if late:
            rows(spark, late).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("date date, stock_id string, v double").parquet(inbox)
        query = upsert_stream(stream, root, state)
        query.awaitTermination()
    assert {(r.stock_id, r.v) for r in A.scan_panel(spark, root).collect()} == {("a", 5.0), ("b", 2.0)}


def test_null_dates_are_refused_and_stored_ones_stay(spark):
    root = scratch_path(spark, "p")
    A.write_by_year(rows(spark, (D(2020, 1, 2), "a", 1.0), (None, "b", 2.0)), root, overwrite=True)
    with pytest.raises(ValueError, match="without date"):
        A.write_by_year(rows(spark, (None, "c", 3.0)), root)
    A.write_by_year(rows(spark, (D(2020, 1, 3), "a", 4.0)), root)
    assert sorted(r.v for r in A.scan_panel(spark, root).collect()) == [1.0, 2.0, 4.0]


def test_scan_reads_nan_as_null(spark):
    root = scratch_path(spark, "p")
    A.write_by_year(rows(spark, (D(2020, 1, 2), "a", float("nan"))), root, overwrite=True)
    assert A.scan_panel(spark, root).first().v is None


def test_arrival_decides_inside_a_batch(spark):
    df = spark.createDataFrame([(D(2020, 1, 2), "a", 1.0, 2), (D(2020, 1, 2), "a", 5.0, 1)],
                               "date date, stock_id string, v double, seq int")
    assert A.keep_last([df.repartition(2)], arrival="seq").first().v == 1.0
    assert A.keep_last([df.repartition(2)]).first().v == 5.0


def test_signal_frame_wants_one_row_of_metadata(spark):
    meta = spark.createDataFrame([("m0",), ("m1",)], "model_name string")
    meta = meta.withColumns({c: F.lit(None).cast(t) for c, t in S.SIGNAL_FIELDS.items() if c not in (
        "model_name", "date", "stock_id", "raw_score", "created_time")})
    scores = spark.createDataFrame([(D(2020, 1, 2), "a", 1.0)], "date date, stock_id string, raw_score double")
    with pytest.raises(ValueError, match="exactly one row"):
        S.signal_frame(scores, meta)
    assert S.signal_frame(scores, meta.limit(1)).count() == 1


def test_shuffles_start_with_many_partitions_unless_the_session_says_otherwise(spark):
    from paneltide.session import ASSUMED, assume
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.unset(key)
    try:
        scratch_path(spark, "p")
        assert spark.conf.get(key) == ASSUMED[key]
        spark.conf.set(key, "3")
        assume(spark)
        assert spark.conf.get(key) == "3"
    finally:
        spark.conf.unset(key)
