"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from weft.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in registry.SQL:
        assert rows
        return
    got = con.execute(registry.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()]
    assert sorted(map(str, rows)) == sorted(map(str, want))
