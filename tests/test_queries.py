"""Every query of the library itself against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "events lineitem conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_oracle(spark, oracle, name, tmp_path):
    catalogue.QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    oracle.execute(f"CREATE OR REPLACE TABLE expected AS {catalogue.ORACLE_SQL[name]}")
    columns = sorted(r[0] for r in oracle.execute("DESCRIBE expected").fetchall())
    names = ", ".join(f'"{c}"' for c in columns)
    oracle.execute(f"CREATE OR REPLACE TABLE got AS SELECT {names} FROM '{tmp_path}/out/*.parquet'")
    for a, b in (("got", "expected"), ("expected", "got")):
        assert oracle.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b}").fetchall() == []
