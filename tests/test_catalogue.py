"""Every registered catalogue query against its SQL, on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from catalake.plans import catalogue, details, scans, shops  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "None" if math.isnan(v) else repr(round(float(v), 6))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    out = catalogue.QUERIES[name](spark, SF)
    got = out.collect()
    if name not in catalogue.SQL:
        assert got
        return
    result = db.execute(catalogue.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(out.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got) == want
    assert want
