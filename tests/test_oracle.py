import pytest

from tessera import catalog
from tests.oracle import SF, compare

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert compare(spark, catalog.queries()[name], SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
