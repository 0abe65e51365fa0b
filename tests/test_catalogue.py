"""Every query of the engine against its SQL, over the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from lorewell.plans import catalogue

DATA = os.environ.get("LOREWELL_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return found


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: x.tolist() if isinstance(x, np.ndarray) else None if x is None or x != x else x
    return sorted(repr([plain(x) for x in r]) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(catalogue.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
