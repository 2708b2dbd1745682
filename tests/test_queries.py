"""Registered queries against their SQL on the smallest tables: one per category, or all with ``ALL_QUERIES=1``."""

import os

import pytest

import __spark_entry__ as entry
import verify

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["a4_test_candidates", "p6_waterfall", "f8_dhash", "j5_anti_chain", "j6_near_pairs", "u3_exact_or_near", "h3_decide_clusters", "h7_partition",
          "e3_evaluate_locked", "e5_paired_ci", "q4_qc_leakage", "w6_throughput_alerts", "t4_balanced_sample", "s3_read_canonical", "k5_fingerprint",
          "x1_stream_utilisation"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    line = verify.compare(spark, verify.connect(FOLDER), FOLDER, name)
    assert line.startswith("ok"), line


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "images", "verified", "country", "test_candidate"] and df.count() > 0
