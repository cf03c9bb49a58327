"""Every registered query with an oracle, against DuckDB on the same files."""

import pytest
from compare import compare, connect

from barspan.plans.registry import load_all

QUERIES, ORACLES = load_all()
# too slow for a unit run; their parts have tests of their own
SLOW = {"a26_results_over_seeds", "m8_walk_forward_models", "m10_noise_probe_fit", "m9_ranking_regression"}


# SQL cannot express these; a further query without an oracle is a mistake
WITHOUT_ORACLE = {
    "w20_all_base_features", "a7_trend_significance", "m8_walk_forward_models", "m9_ranking_regression", "m10_noise_probe_fit",
    "m12_frozen_model_scores", "a26_results_over_seeds",
}


def test_every_query_has_an_oracle_or_a_reason():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == WITHOUT_ORACLE


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, duck, sf_dir, name):
    ok, message = compare(spark, duck, sf_dir, name, QUERIES[name], ORACLES.get(name), exact=False)
    assert ok, message
