"""A sample of the registered queries against the SQL engine, on the smallest tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "bloom_build", "eval_first_match", "eval_owner", "shared_keys", "parse_key", "char_ngrams", "numeric_ngrams", "tfidf", "std_scale",
    "rp_intervals", "two_stage_lookup", "eval_first_match_model", "kfold", "compile_obs", "best_constrained", "parse_flush_log", "live_tables",
    "stream_counters",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    ok, note, _, _ = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert ok, note


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
