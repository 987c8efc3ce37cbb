"""Each query that has SQL against DuckDB, on the smallest tables."""
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tagloom.plans import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = load()
NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def results(spark, data):
    """Results of all queries, several at a time: most of the time is planning."""
    pool = ThreadPoolExecutor(6)
    yield {n: pool.submit(lambda n=n: QUERIES[n](spark, data).toPandas()) for n in NAMES}
    pool.shutdown(cancel_futures=True)


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and v != v:
        return None
    return v.item() if hasattr(v, "item") else v


def values(frame, columns):
    return sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(results, duck, name):
    a, b = results[name].result(), duck.execute(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert values(a, sorted(a.columns)) == values(b, sorted(a.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
