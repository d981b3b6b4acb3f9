"""Every query with a SQL counterpart returns the same rows in Spark and DuckDB; the others run."""

import math
import os

import duckdb
import pytest

from quarry.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = ordered(tuple(plain(x) for x in r) for r in df.collect())
    cursor = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    place = [columns.index(c) for c in df.columns]
    want = ordered(tuple(plain(r[i]) for i in place) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
