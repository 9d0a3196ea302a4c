import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight.operators import autoencoder as ae
from sparsight.operators.dense import dense_topk
from sparsight.plans import retrieval as B


@pytest.fixture(scope="module")
def setup(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = lambda key, rows: spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())], f"{key} long, vec array<double>")
    weights, bias = ae.init_weights(ae.feature_ids(spark, 48), 16, 48, 2)
    return frame("qid", x[:12]), frame("pid", x[12:]), ae.SparseModel.of(weights, bias)


def rows(df):
    return sorted((r.qid, r["rank"], r.pid, round(r.score, 9)) for r in df.collect())


def float32(df):
    return df.withColumn("vec", F.col("vec").cast("array<float>"))


def test_delta_zero_is_a_search_with_the_double_reconstruction(setup):
    queries, passages, model = setup
    once = float32(ae.reconstruct(queries, model, 6, ["qid"]))
    twice = float32(ae.reconstruct(once, model, 6, ["qid"]))
    p_hat = float32(ae.reconstruct(passages, model, 6, ["pid"]))
    assert rows(B.retrieve_feedback(queries, passages, model, 6, 3, 2, 0.0, 5)) == rows(dense_topk(twice, p_hat, 5))


def test_sweep_equals_single_runs(setup):
    queries, passages, model = setup
    grid = [(1, 1, 0.04), (3, 2, 0.16), (2, 4, 0.64)]
    swept = B.feedback_sweep(queries, passages, model, 6, 5, grid)
    assert swept.count() == len(grid) * 12 * 5
    for hits, features, delta in grid:
        one = B.retrieve_feedback(queries, passages, model, 6, hits, features, delta, 5)
        assert rows(swept.filter(F.col("config") == B.config_name(hits, features, delta))) == rows(one)


def test_grid():
    grid = B.feedback_grid()
    assert len(grid) == len(set(grid)) == 136
    assert (8, 8, 0.64) in grid and (16, 1, 0.64) not in grid and (1, 16, 0.64) not in grid and (32, 16, 0.32) in grid


def test_expansion_adds_once_and_also_to_new_features(spark):
    postings = spark.createDataFrame([(1, 5, 1.0), (1, 6, 2.0)], "qid long, feature int, weight double")
    found = spark.createDataFrame([(1, 6), (1, 7), (1, 7)], "qid long, feature int")
    got = B.expand_query(postings, B.feedback_union(found), 0.5).collect()
    assert sorted((r.feature, r.weight) for r in got) == [(5, 1.0), (6, 2.5), (7, 0.5)]


def test_latent_search_scores(setup):
    queries, passages, model = setup
    q = {}, {}
    for side, frame, key in ((0, queries, "qid"), (1, passages, "pid")):
        for r in ae.latent_postings(frame, model, 6, [key]).collect():
            q[side].setdefault(r[key], {})[r.feature] = r.weight
    for r in B.retrieve_latent(queries, passages, model, 6, 4).collect():
        a, b = q[0][r.qid], q[1][r.pid]
        assert r.score == pytest.approx(sum(a[f] * b[f] for f in a.keys() & b.keys()))
        assert a.keys() & b.keys()
    wide = B.retrieve_latent_wide(queries, passages, model, 6, 20)
    assert rows(wide) == rows(B.retrieve_latent(queries, passages, model, 6, 20, query_latent_k=20))


def test_reconstructed_search(setup):
    queries, passages, model = setup
    q_hat = float32(ae.reconstruct(queries, model, 6, ["qid"]))
    p_hat = float32(ae.reconstruct(passages, model, 6, ["pid"]))
    assert rows(B.retrieve_reconstructed(queries, passages, model, 6, 4)) == rows(dense_topk(q_hat, p_hat, 4))


def test_sweep_with_repeated_passages_and_bounds_above_their_features(setup):
    queries, passages, model = setup
    # Two passages of one id have up to twice as many features.
    twice = passages.withColumn("pid", F.col("pid") % 14)
    grid = [(2, 6, 0.16), (2, 8, 0.16), (2, 16, 0.16), (2, 32, 0.16)]
    swept = B.feedback_sweep(queries, twice, model, 6, 5, grid).collect()
    for hits, features, delta in grid:
        one = B.retrieve_feedback(queries, twice, model, 6, hits, features, delta, 5)
        mine = [r for r in swept if r.config == B.config_name(hits, features, delta)]
        assert sorted((r.qid, r["rank"], round(r.score, 9)) for r in mine) == [(q, n, s) for q, n, _, s in rows(one)]
