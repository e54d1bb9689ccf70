import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from papyrite import catalog_of_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if pd.isna(x) else repr(float(x)) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)
    return list(frame.columns), sorted(tuple(map(str, map(plain, r))) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog_of_queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert rows(catalog_of_queries.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(catalog_of_queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog_of_queries.queries()) - set(catalog_of_queries.oracle_sql())))
def test_runs(spark, name):
    assert catalog_of_queries.queries()[name](spark, DATA).count() > 0
