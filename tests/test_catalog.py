import math

import pytest

import __spark_entry__ as entry
from loomgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    want = duck.sql(catalog.ORACLES[name])
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "id", "doc_id", "text", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
