"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for name in check_oracles.TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return db


# The sweep's SQL alone takes twenty seconds; check_oracles.py and test_retrieval.py cover it.
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - {"feedback_sweep"}))
def test_query_equals_sql(spark, database, name):
    df = entry.queries()[name](spark, SF)
    cursor = database.execute(entry.oracle_sql()[name])
    mine = check_oracles.normalized(df.columns, [tuple(r) for r in df.collect()])
    assert mine == check_oracles.normalized([c[0] for c in cursor.description], cursor.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5000


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
