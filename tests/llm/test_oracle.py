"""The registered queries of the subpackage against their SQL, and what the driver sees."""

import pytest

import __spark_entry__
from tests.compare import connect, differences
from twinfold.llm.oracle import oracle_sql
from twinfold.llm.queries import queries

SQL = oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, sf_dir, name):
    assert differences(queries()[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []


def test_all_are_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(SQL) <= set(names)
