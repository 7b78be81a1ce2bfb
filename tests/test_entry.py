"""The driver's entry, with and without the training-data operators."""

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, small):
    assert entry.entry(spark).count() > 0
