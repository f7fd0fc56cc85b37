"""A spread of registered queries against their DuckDB oracles on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("a3_outlinks", "b7_status_assignment", "b8_exact_duplicates", "c4_watchlist_text_match", "d2_hashing_embedding", "e4_rules_by_similarity", "e8_coherence_outliers",
          "f5_best_move_score", "f14_escalation_log", "f15_suppression", "f21_local_evidence", "g17_slow_stages", "h2_retention_apply", "i2_stream_poll_state",
          "i3_stream_escalations", "flagship_alert_candidates")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    message, _, _ = compare(spark, oracle_connection(FOLDER), FOLDER, name, queries()[name], oracle_sql()[name])
    assert message.startswith("ok"), message
