"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from palimpsest.plans import catalogue

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="test tables are not here")


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    try:
        return f"{float(value):.6g}" if not isinstance(value, (str, int)) else str(value)
    except (TypeError, ValueError):
        return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{BASE}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, BASE)
    own = rows(frame.columns, frame.collect())
    if name in catalogue.ORACLES:
        result = duck.sql(catalogue.ORACLES[name])
        assert sorted(result.columns) == sorted(frame.columns)
        assert rows(list(result.columns), result.fetchall()) == own
    else:
        assert frame.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
