"""The registered queries against their SQL in DuckDB, where the test data is."""

import math
from pathlib import Path

import pytest

from meldframe.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return bytes(v).hex() if isinstance(v, bytes | bytearray) else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    mine = QUERIES[name](spark, str(DATA))
    order = sorted(mine.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in mine.collect())
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == order
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cur.fetchall())
