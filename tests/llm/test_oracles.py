"""The operators' queries against their SQL."""

import pytest

from docloom.llm.queries import ORACLES, QUERIES

from ..oracle import connect, spark_rows, sql_rows

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, DATA))
    sql_names, expected = sql_rows(connect(DATA), ORACLES[name])
    assert names == sql_names and rows == expected
