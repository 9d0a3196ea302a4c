"""Registered queries against their SQL, and the pipeline's stages against each other."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from sparsight.llm.queries import QUERIES, SQL
from sparsight.storage import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = Counter(tuple(r) for r in got.select(columns).collect())
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert rows == Counter(tuple(map(plain, r)) for r in expected)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert {f"op{i}" for i in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in QUERIES}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert bench
    kept = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= set(before) and all(r.n_chars == len(r.text) for r in rows)
        kept.append(len(rows))
    assert kept[0] > kept[1] == kept[2] > kept[3] >= kept[4] > 0
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert Counter(tuple(r[:5]) for r in P.run(spark, SF).collect()) == Counter(tuple(r[:5]) for r in packed)


def test_pipeline_on_awkward_rows(spark, awkward_docs, no_docs):
    for docs in (awkward_docs, no_docs):
        for _, stage in P.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF), "stage")
        P.STAGES[-1][1](spark, docs, SF).count()
