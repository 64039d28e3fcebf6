"""Every query with SQL against DuckDB, over the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from cellweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: tsne_quality and leiden_quality run the same work.
SLOW = {"tsne", "leiden"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = db.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_query_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
