"""The stored dense index: exact hits with skipped blocks, versions that stay as they were."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight.operators import blocks, dense, dense_index


def frame(spark, key, x, first=0):
    rows = [(i, first + i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"row_idx long, {key} long, vec array<double>").repartition(3)


def hits(df):
    return sorted((r.qid, r["rank"], r.pid, r.score) for r in df.collect())


def clustered(rng, centres, n, dim):
    return centres[rng.integers(len(centres), size=n)] + 0.05 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("send", [blocks.SEND_BYTES, 4000])
def test_hits_are_those_of_the_plain_search(spark, base, monkeypatch, send):
    monkeypatch.setattr(dense_index, "BLOCK_ROWS", 50)
    monkeypatch.setattr(dense_index, "SEND_BYTES", send)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    p, q = clustered(rng, centres, 3000, 16), clustered(rng, centres, 30, 16)
    p[7] = p[2000]  # a tie
    p[11, 3], p[12, 0], q[4, 1] = np.nan, np.inf, np.nan
    queries = frame(spark, "qid", q).select("qid", "vec")
    dense_index.add(spark, base, "m", frame(spark, "pid", p[:2500]))
    dense_index.add(spark, base, "m", frame(spark, "pid", p[2500:], 2500))
    got = dense_index.search(spark, base, "m", queries, 6)
    assert got.filter("row_idx <> pid").isEmpty()  # numbers go on from part to part
    assert hits(got) == hits(dense.dense_topk(queries, frame(spark, "pid", p).select("pid", "vec"), 6))
    assert dense_index.skipped_share(spark, base, "m", queries, 6) > 0.3
    plan = dense_index.search(spark, base, "m", queries, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(qid" in plan


def test_versions_stay(spark, base):
    rng = np.random.default_rng(5)
    p, q = rng.normal(size=(90, 8)), rng.normal(size=(5, 8))
    queries = frame(spark, "qid", q).select("qid", "vec")
    first = dense_index.add(spark, base, "m", frame(spark, "pid", p[:40]))
    before = hits(dense_index.search(spark, base, "m", queries, 3))
    second = dense_index.add(spark, base, "m", frame(spark, "pid", p[40:], 40))
    assert hits(dense_index.search(spark, base, "m", queries, 3, version=first)) == before != hits(dense_index.search(spark, base, "m", queries, 3))
    stored = {(r.row_idx, r.pid): r.vec for r in dense_index.open_vectors(spark, base, "m", second).collect()}
    assert stored == {(i, i): p[i].tolist() for i in range(90)}
    assert dense_index.open_vectors(spark, base, "m", first).count() == 40
    broken = frame(spark, "pid", p[:3]).withColumn("vec", F.expr("transform(vec, x -> if(pid = 1, raise_error('stop'), x))"))
    with pytest.raises(Exception, match="stop"):
        dense_index.add(spark, base, "m", broken)
    assert dense_index.newest_version(spark, base, "m").version == second


def test_what_is_refused(spark, base):
    dense_index.add(spark, base, "m", frame(spark, "pid", np.ones((4, 3))))
    with pytest.raises(ValueError, match="width"):
        dense_index.add(spark, base, "m", frame(spark, "pid", np.ones((4, 5))))
    with pytest.raises(Exception, match="width"):
        dense_index.search(spark, base, "m", frame(spark, "qid", np.ones((2, 5))), 2).collect()
    for version in (None, 9):
        with pytest.raises(ValueError, match="no index"):
            dense_index.search(spark, base, "other" if version is None else "m", frame(spark, "qid", np.ones((2, 3))), 2, version=version)
    assert dense_index.search(spark, base, "m", frame(spark, "qid", np.ones((0, 3))), 2).count() == 0


def test_best_hits_keep_k_and_their_edge():
    rng = np.random.default_rng(1)
    best, seen = blocks.BestHits(4, 3), []
    for _ in range(30):
        rows, keys = rng.integers(0, 3, 5), rng.integers(0, 99, 5)
        scores = rng.integers(0, 20, 5).astype(float)
        seen += list(zip(rows.tolist(), (-scores).tolist(), keys.tolist()))
        best.add(rows, scores, key=keys)
    wanted = [h for r in range(4) for h in sorted(x for x in seen if x[0] == r)[:3]]
    got = best.table.to_pydict()
    assert sorted(zip(got["row"], [-s for s in got["score"]], got["key"])) == sorted(wanted)
    assert best.edge[3] == -np.inf and all(best.edge[r] == -wanted[3 * r + 2][1] for r in range(3))
