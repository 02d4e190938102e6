import pytest

from tessera import llm
from tests.oracle import connect, difference

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert not difference(spark, connect(DATA), llm.queries()[name], llm.oracle_sql()[name], DATA)
