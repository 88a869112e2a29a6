"""Every registered query against its oracle, and the shape of those without one."""

import pytest

from oracle import compare, connect
from postlens.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()
# these train for a minute each; test_learned_queries.py runs them with less work
SLOW = {"train_open_vocabulary", "train_rf", "train_lr", "feature_importance", "model_summary", "analyze_postings", "scam_score"}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("key", sorted(set(ORACLES) - SLOW))
def test_matches_oracle(spark, duck, data, key):
    assert compare(spark, duck, data, QUERIES[key], ORACLES[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(spark, data, key):
    assert QUERIES[key](spark, data).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
