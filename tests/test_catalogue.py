"""Every registered query of the search engine gives the rows of its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from folioscan.plans.catalogue import QUERIES
from folioscan.plans.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "part", "pages", "conversations"):
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return con



@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got) and not got.isna().all().any()
        return
    want = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    one = sorted((tuple(None if pd.isna(v) else v for v in r) for r in got[sorted(got.columns)].itertuples(index=False)), key=key)
    two = sorted((tuple(None if pd.isna(v) else v for v in r) for r in want[sorted(want.columns)].itertuples(index=False)), key=key)
    assert len(one) == len(two) and all(a == b or all(x == y for x, y in zip(a, b, strict=True)) for a, b in zip(one, two, strict=True))
