"""Every registered query against its SQL over the same tables, on the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.parity import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# Learned models need more rows than the smallest scale has.
MODELS = {"entry_model_scores", "threshold_sweep", "untouched_test", "event_ownership_scores", "permutation_importance", "feature_ablation", "stream_scores"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, QUERIES[name], ORACLES.get(name), SF.replace("0.001", "0.01") if name in MODELS else SF)
    assert ok, message


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["config", "split"]
