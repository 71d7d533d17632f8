"""Every query with SQL gives what its SQL gives; the others give rows."""

import pytest

from fairlead.plans import catalog

from .compare import same, tables
from .conftest import SMALL


@pytest.fixture(scope="module")
def db():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], db)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
