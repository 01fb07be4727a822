"""Each registered query against its SQL; those without SQL must at least give rows."""

import pytest

from oracle import connected, same_rows
from quirework.plans import media, pages, relational, stores, streams

QUERIES = pages.QUERIES | stores.QUERIES | media.QUERIES | relational.QUERIES | streams.QUERIES
SQL = pages.SQL | stores.SQL | media.SQL | relational.SQL | streams.SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connected(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same_rows(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
