import pytest

from framewright.llm import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.001")


def test_one_query_an_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))
