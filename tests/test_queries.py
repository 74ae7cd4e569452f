"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from docloom.plans import record_queries, registry, text_queries  # noqa: F401

from .oracle import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    names, rows = spark_rows(registry.QUERIES[name](spark, sf))
    sql_names, expected = sql_rows(duck, registry.SQL[name])
    assert names == sql_names
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    assert {"field", "precision", "recall", "f1"} <= set(__spark_entry__.entry(spark).columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
