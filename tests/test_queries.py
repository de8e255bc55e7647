"""Every registered query with SQL gives the SQL's rows on the smallest tables; those without give rows of a stable schema."""

import pytest

from glossa.plans import catalogue
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    same(spark, sf, catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_gives_rows(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert df.columns and df.limit(3).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["text", "n", "n_docs"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
