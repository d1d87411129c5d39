"""Every registered query against its SQL counterpart."""

import pytest

from tests.compare import connect, differences
from twinfold.plans.catalog import queries
from twinfold.plans.oracle import oracle_sql

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []
