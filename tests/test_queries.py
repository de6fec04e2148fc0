"""Every registered query against its SQL twin on the smallest data."""

import pytest
from compare import connect, run_pair

from wardlake.checks import load_queries

QUERIES, ORACLES = load_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    problem, _, _ = run_pair(spark, con, name, QUERIES, ORACLES, sf_dir)
    assert problem is None


def test_most_queries_have_a_twin():
    without = sorted(set(QUERIES) - set(ORACLES))
    assert without == sorted(
        ["importance_ranking", "model_boosting", "model_forest", "model_logistic",
         "model_perceptron", "model_with_code_lists", "training_texts"]
    )
