import pytest

from millrace.plans import catalogue
from tests.oracle import DATA, connect, same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    same(df, con, SQL[name])
