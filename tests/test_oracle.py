"""Every library query with SQL gives the rows that an independent engine gives."""

import duckdb
import pytest

from nadir.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "NULL"
    return f"{float(v):.5f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, engine, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = engine.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # a column of ints with nulls is float in one of the two
        if got[c].dtype.kind != want[c].dtype.kind and {got[c].dtype.kind, want[c].dtype.kind} <= set("if"):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)
