"""Every query of the linter against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from codesieve.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def order(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert rows
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        at = [d[0] for d in result.description]
        assert sorted(at) == columns
        want = [tuple(r[at.index(c)] for c in columns) for r in result.fetchall()]
        assert sorted(rows, key=order) == sorted(want, key=order)
