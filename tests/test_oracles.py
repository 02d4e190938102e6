import pytest

from tessera.plans import registry
from tests.oracle import connect, difference

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert not difference(spark, connect(DATA), registry.queries()[name], registry.oracle_sql()[name], DATA)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, DATA).limit(5).count() > 0
