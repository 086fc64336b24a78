"""Every registered query of the library's own operators against its DuckDB SQL, on the smallest tables."""

import pytest
from compare import connection, rows
from test_brute_force import COVERED

from tally import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def duck(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(name, spark, data, duck):
    assert rows(QUERIES[name](spark, data)) == rows(duck.execute(SQL[name]))


def test_what_has_no_sql_has_a_test_of_its_own():
    assert QUERIES.keys() - SQL.keys() == COVERED


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()
