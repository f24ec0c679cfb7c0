import duckdb
import pytest

import __spark_entry__ as entry
from mnemoflow import plans


def rows(frame):
    columns = sorted(frame.columns)
    value = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted((tuple(value(x) for x in r) for r in frame[columns].itertuples(index=False)), key=repr)


def test_every_text_has_its_query():
    assert set(plans.ORACLE) <= set(plans.QUERIES) and len(plans.QUERIES) > 45


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    con.execute("set temp_directory=''")
    for table in ("messages", "chats", "fragments", "documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    got = entry.queries()[name](spark, small).toPandas()
    want = con.execute(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got.astype(object)) == rows(want.astype(object))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
