"""The entry points: names, SQL and a query of each kind at the smallest size."""

import __spark_entry__ as entry


def test_names_and_sql():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 1500 and df.columns == entry.entry(spark).columns
