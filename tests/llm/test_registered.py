"""Registered queries of the operators that SQL can express."""

import os

import pytest

import __spark_entry__ as entry
from compare import check, duck

FOLDER = os.environ.get("PANELTIDE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_operator_has_one_query():
    names = sorted(n for n in entry.queries() if n.startswith("op"))
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_top_k", "op6_ngram_join", "op8_mixing", "op10_warc", "op12_merkle_manifest",
                                  "op13_lexical_search"])
def test_matches_sql(spark, name):
    problem, n, _ = check(spark, duck(FOLDER), FOLDER, name, entry)
    assert problem is None and n
