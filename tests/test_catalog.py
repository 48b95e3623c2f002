"""Every catalogued query against DuckDB: names, types and values."""

import duckdb
import pytest

from tidemill.plans.catalog import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    q = queries()[name]
    df = q(spark, SF)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    if q.sql is None:
        assert len(rows) == 25
        return
    rel = duck.sql(q.sql)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {n: SAME[t] for n, t in df.dtypes} == kinds
    cols = ", ".join(f'"{c}"' for c in sorted(rel.columns))
    assert rows == sorted(map(repr, duck.execute(f"select {cols} from ({q.sql})").fetchall()))
