"""Queries of this subpackage that SQL can express return the same rows in Spark and DuckDB."""

import os

import duckdb
import pytest

from quarry.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted((tuple(plain(x) for x in r) for r in cursor.fetchall()), key=str)
