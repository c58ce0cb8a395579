"""Every registered query that has SQL gives the SQL's rows; the others run and give rows."""

import pytest

import __spark_entry__ as entry
from compare import duck_rows, spark_rows

OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, data, name):
    df = entry.queries()[name](spark, data)
    got, sql = spark_rows(df), entry.oracle_sql().get(name)
    if sql:
        assert got == duck_rows(sql, data, df.columns)
    elif name != "H4_extract_images":  # the pages have no images
        assert got


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
