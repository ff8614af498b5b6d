"""Every query of the catalogue against its SQL twin; those without one must give rows of a stable schema."""

import pytest

from ledgerloom import registry

from .compare import connect, rows

registry.load()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, data, con, name):
    ours, sql = registry.QUERIES[name](spark, data).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert rows(ours) == rows(sql)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry_works_without_the_training_data_operators():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.ORACLES) <= set(e.oracle_sql())
