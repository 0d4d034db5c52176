"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest

from conftest import DATA, rows_of
from rivulet.queries import ORACLES, QUERIES

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, oracle, name):
    names, rows = rows_of(QUERIES[name](spark, f"{DATA}/{SF}"))
    assert (names, rows) == oracle(SF, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
