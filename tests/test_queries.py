"""Every query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quirework.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    return str(round(float(x), 9)) if isinstance(x, (float, int, np.floating, np.integer)) else str(x)


def rows(frame):
    columns = sorted(frame.columns)
    kept = frame[columns].astype(object)
    return columns, sorted(map(tuple, kept.where(kept.notna(), None).map(plain).values.tolist()))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert rows(catalogue.queries()[name](spark, sf_dir).toPandas()) == rows(duck.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
