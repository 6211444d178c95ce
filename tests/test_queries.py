"""Registered queries of the library against their SQL twins on the smallest tables.

``PANELTIDE_QUICK=1`` runs a cheap selection; ``python tests/compare.py`` prints a table for
any scale.
"""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import check, duck, difference
from paneltide.plans import catalog

FOLDER = os.environ.get("PANELTIDE_DATA", "/root/testdata/sf0.001")
QUICK = ["a1_", "a2_", "a3_", "a4_", "a6_", "a8_", "b1_", "b3_", "b4_", "b5_fill_ind", "b6_", "b7_",
         "c1_", "c2_", "c4_", "c7_", "c11_", "d1_", "d2_", "d3_", "d4_", "f1_", "g1_", "g2_", "g5_",
         "g7_", "g10_", "h1_", "i2_", "i5_", "i6_", "i9_", "i13_"]
NAMES = [n for n in catalog.QUERIES
         if not os.environ.get("PANELTIDE_QUICK") or n.startswith(tuple(QUICK))]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problem, _, _ = check(spark, con, FOLDER, name, entry)
    assert problem is None


def test_forward_return_of_days_worth_nothing_and_of_ties(spark, tmp_path):
    cents = {1: [0, 5, 0, 7, 0, 0], 2: [640, 1, 1, 22107, 16000, 24011]}  # 33.5421875 is a tie
    rows = [(100 * user + day, f"2024-01-{day + 1:02d} 08:00:00", user, "view", value / 100.0)
            for user, values in cents.items() for day, value in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn(
        "ts", F.to_timestamp("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    problem, n, _ = check(spark, con, str(tmp_path), "c1_forward_return_gaps", entry)
    assert problem is None and n == 12


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["date", "rank_ic"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_comparison_sees_differences():
    assert difference([(1.0, "a")], [(1.0, "a")]) is None
    assert difference([(1.0, "a")], [(1.1, "a")]) and difference([], [(1,)])
