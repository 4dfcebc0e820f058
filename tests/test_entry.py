import __spark_entry__ as entry


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "bm25_scene" in entry.queries()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
