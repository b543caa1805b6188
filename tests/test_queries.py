import os

import pytest

import __spark_entry__ as entry
from keyloom import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = sorted(engine.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    rel = duck.sql(engine.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=repr)
    assert got == sorted(rel.fetchall(), key=repr)
