import pytest

from tests.conftest import DATA
from tests.oracle import connect, same
from tidewatch.plans import catalog

FOLDER = str(DATA / "sf0.001")
SLOW = {"learn_gboost", "learn_forest", "learn_vote", "learn_choice", "learn_ablation", "learn_logreg"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, FOLDER), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - SLOW))
def test_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_sql_names_are_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert catalog.SQL["filter_eq_as_of"]
