import pytest
from oracle import connect, same

from pairloom.plans import registry

TEXTS = registry.oracle_sql()
ROWS_ONLY = {"q_train_lr"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_matches_duckdb(spark, sf, con, name):
    same(spark, sf, con, registry.queries()[name], TEXTS[name])


def test_all_have_texts():
    assert set(registry.queries()) - set(TEXTS) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
