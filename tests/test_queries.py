"""Every registered query against its SQL on the given tables."""

import oracle
import pytest

from ledgerlight import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    differences, rows = oracle.compare(spark, con, QUERIES[name], SQL[name], sf_dir)
    assert not differences, "\n".join(differences)
    # Few accounts have an unusual weekday at the smallest scale.
    assert rows > 0 or name == "seasonal_deviation"


def test_every_query_is_checked():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
