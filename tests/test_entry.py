import __spark_entry__ as entry


def test_names_and_entry(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    assert entry.entry(spark).count() > 0
