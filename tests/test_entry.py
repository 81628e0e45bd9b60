import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() == 10 and "value" in out.columns
