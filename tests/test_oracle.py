"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from stabilis.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame)]
    frame = frame.astype(object).where(frame.notna(), None)
    fix = lambda v: round(v + 0.0, 6) if isinstance(v, float) else v
    return sorted((tuple(map(fix, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got) == sorted(want)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert os.path.isdir("/root/testdata")
