import pytest

from docloom.llm import queries
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
