"""Every container query against its SQL on DuckDB."""

import pytest
from conftest import SF, same_rows

from cargohold import queries as q


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(name, spark, duck):
    found = q.queries()[name](spark, SF)
    same_rows(found, duck.execute(q.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
