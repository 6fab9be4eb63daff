"""Every registered query of the reference operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sluice import catalog, oracles

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_every_oracle_has_its_query():
    assert set(oracles.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cur = con.execute(oracles.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r) for r in cur.fetchall()]
    got = [tuple(r) for r in df.select(*names).collect()]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracles.ORACLES)))
def test_replayed_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
