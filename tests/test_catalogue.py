import math
import os

import duckdb
import pytest

from wavelark.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(row, columns):
    """Numbers that are whole are compared as such, and null is None."""
    return tuple(None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x for x in (row[c] for c in columns))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_equal(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA)
    expected = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    rows = [dict(zip(expected.columns, r, strict=True)) for r in expected.fetchall()]
    assert sorted((plain(r, columns) for r in found.collect()), key=repr) == sorted((plain(r, columns) for r in rows), key=repr)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_whole_tables(spark):
    """Range, merges and export have a query over every stream, not only over some ids."""
    found, rows = catalogue.queries(), catalogue.events(spark, DATA).cache()
    ids, n = {r.stream_id for r in rows.select("stream_id").distinct().collect()}, rows.count()
    inside = rows.filter(f"t >= {catalogue.EVENTS_RANGE.begin} AND t < {catalogue.EVENTS_RANGE.end}")
    assert found["range_changes_all"](spark, DATA).count() == inside.count()
    assert found["merge_tagged_all"](spark, DATA).count() == n + rows.filter("stream_id % 3 = 0").count()
    mixed = found["mixed_merge_all"](spark, DATA).collect()
    assert sum(r.source % 5 == 0 for r in mixed) == inside.count() and {r.source % 5 for r in mixed} == {0, 1, 2, 3, 4}
    lines = found["export_lines_all"](spark, DATA).collect()
    assert len(lines) == n and {r.source for r in lines} == ids
    rows.unpersist()
