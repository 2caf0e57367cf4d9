"""Every registered query against its SQL on the smallest tables."""

import pytest

from lectern.plans import registry


def plain(value):
    return round(value, 6) if isinstance(value, float) else tuple(value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in registry.oracle_sql():
        assert got
        return
    sql = registry.oracle_sql()[name]
    found = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})")
    assert sorted(duck.sql(sql).columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "chunk_id", "page_number", "page_range", "word_count", "content"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
