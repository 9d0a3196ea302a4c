import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight.operators import autoencoder as ae
from sparsight.operators import blocks


def small_model(spark, size=16, dim=32, seed=3, **options):
    return ae.SparseModel.of(*ae.init_weights(ae.feature_ids(spark, size), dim, size, seed), **options)


def arrays(model):
    rows = model.weights.orderBy("feature").collect()
    return (np.array([r.w_enc for r in rows]), np.array([r.b_enc for r in rows]),
            np.array([r.w_dec for r in rows]), np.array(model.b_dec))


def vectors(spark, x):
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, vec array<double>")


def forward(x, model, k, centred=True):
    w_enc, b_enc, w_dec, b_dec = arrays(model)
    a = (x - b_dec if centred else x) @ w_enc.T + b_enc
    f = np.zeros_like(a)
    top = np.argsort(-a, axis=1, kind="stable")[:, :k]
    np.put_along_axis(f, top, np.maximum(np.take_along_axis(a, top, 1), 0), 1)
    return a, f, f @ w_dec + b_dec


def dense_of(postings, n, size):
    out = np.zeros((n, size))
    for r in postings.collect():
        out[r.id, r.feature] = r.weight
    return out


def vec_of(df):
    return np.array([r.vec for r in df.orderBy("id").collect()])


def test_forward_shapes_and_values(spark):
    x = np.random.default_rng(0).random((8, 32))
    model = small_model(spark)
    _, f, hat = forward(x, model, 4)
    codes = ae.ksparse_features(vectors(spark, x), model, 4, ["id"])
    assert codes.count() <= 8 * 4
    np.testing.assert_allclose(dense_of(codes, 8, 16), f, atol=1e-12)
    np.testing.assert_allclose(vec_of(ae.reconstruct(vectors(spark, x), model, 4, ["id"])), hat, atol=1e-12)


def test_encode_and_latents_are_not_centred(spark):
    x = np.random.default_rng(1).normal(size=(6, 32))
    model = small_model(spark)
    a, f, _ = forward(x, model, 5, centred=False)
    rows = ae.encode(vectors(spark, x), model, ["id"]).collect()
    got = np.zeros_like(a)
    for r in rows:
        got[r.id, r.feature] = r.activation
    np.testing.assert_allclose(got, a, atol=1e-12)
    np.testing.assert_allclose(dense_of(ae.latent_postings(vectors(spark, x), model, 5, ["id"]), 6, 16), f, atol=1e-12)


def test_center(spark):
    model = small_model(spark)
    row = ae.center(vectors(spark, np.zeros((1, 32))), model).first()
    np.testing.assert_allclose(row.vec, -np.array(model.b_dec))


@pytest.mark.parametrize("block_bytes", [blocks.BLOCK_BYTES, 900])
def test_large_models_give_the_same_result(spark, monkeypatch, block_bytes):
    x = np.random.default_rng(2).normal(size=(30, 32))
    frame, small = vectors(spark, x), small_model(spark, 40)
    large = small_model(spark, 40, broadcast_bytes=0)
    assert small.fits_broadcast() and not large.fits_broadcast()
    with pytest.raises(ValueError):
        large.arrays
    one = sorted(ae.ksparse_features(frame, small, 6, ["id"]).collect())
    hat = vec_of(ae.reconstruct(frame, small, 6, ["id"]))
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    assert sorted(ae.ksparse_features(frame, large, 6, ["id"]).collect()) == one
    np.testing.assert_allclose(vec_of(ae.reconstruct(frame, large, 6, ["id"])), hat, atol=1e-12)


def test_reconstruct_is_decode_of_codes(spark):
    x = np.random.default_rng(4).normal(size=(20, 32))
    frame, model = vectors(spark, x), small_model(spark)
    codes = ae.ksparse_features(frame, model, 3, ["id"])
    assert sorted(ae.decode(codes, model, frame, ["id"]).collect()) == sorted(
        ae.reconstruct(frame, model, 3, ["id"]).collect()
    )


@pytest.mark.parametrize("limit", [ae.BROADCAST_BYTES, 0])
def test_codes_and_reconstruction_in_one_pass(spark, limit):
    x = np.random.default_rng(6).normal(size=(20, 32))
    frame, model = vectors(spark, x), small_model(spark, broadcast_bytes=limit)
    codes, hats = ae.codes_and_reconstruction(frame, model, 3, ["id"])
    assert sorted(codes.collect()) == sorted(ae.ksparse_features(frame, model, 3, ["id"]).collect())
    np.testing.assert_array_equal(
        vec_of(hats).astype(np.float32), vec_of(ae.reconstruct(frame, model, 3, ["id"])).astype(np.float32)
    )


@pytest.mark.parametrize("block_bytes", [blocks.BLOCK_BYTES, 900])
def test_all_negative_activations_decode_to_the_bias(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    weights, bias = ae.init_weights(ae.feature_ids(spark, 16), 32, 16, 3)
    model = ae.SparseModel.of(weights.withColumn("b_enc", F.lit(-100.0)), bias)
    frame = vectors(spark, np.ones((2, 32)))
    codes = ae.ksparse_features(frame, model, 4, ["id"])
    assert codes.count() == 0
    for row in ae.decode(codes, model, frame, ["id"]).collect():
        assert row.vec == list(model.b_dec)


def test_top_k_is_taken_before_the_cut_at_zero(spark):
    x = np.random.default_rng(5).normal(size=(10, 32))
    model = small_model(spark)
    a, _, _ = forward(x, model, 16)
    counts = {r["id"]: r["count"] for r in ae.ksparse_features(vectors(spark, x), model, 16, ["id"]).groupBy("id").count().collect()}
    for i in range(10):
        assert counts.get(i, 0) == (a[i] > 0).sum()


def test_mismatched_shapes_are_refused(spark):
    weights, _ = ae.init_weights(ae.feature_ids(spark, 4), 8, 4, 1)
    _, other = ae.init_weights(ae.feature_ids(spark, 4), 9, 4, 1)
    with pytest.raises(ValueError):
        ae.SparseModel.of(weights, other)


def test_start_weights_are_bounded_and_repeatable(spark):
    one, bias = ae.init_weights(ae.feature_ids(spark, 25), 9, 25, 1)
    two, _ = ae.init_weights(ae.feature_ids(spark, 25).repartition(5), 9, 25, 1)
    assert sorted(one.collect()) == sorted(two.collect())
    rows = one.collect()
    assert max(abs(v) for r in rows for v in [*r.w_enc, r.b_enc]) <= 1 / 3
    assert max(abs(v) for r in rows for v in r.w_dec) <= 1 / 5
    assert len({v for r in rows for v in r.w_enc}) > 200
    assert max(abs(v) for v in bias.first().b_dec) <= 1 / 5


def test_decode_gives_the_same_bits_in_any_number_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    weights = spark.createDataFrame(
        [(f, rng.normal(size=6).tolist(), float(rng.normal()), rng.normal(size=6).tolist()) for f in range(0, 120, 1)],
        "feature int, w_enc array<double>, b_enc double, w_dec array<double>",
    )
    bias = spark.createDataFrame([(rng.normal(size=6).tolist(),)], "b_dec array<double>")
    vectors = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)], "id int, vec array<double>")
    sent = ae.SparseModel.of(weights, bias)
    kept = sorted(map(tuple, ae.reconstruct(vectors, sent, 50, ["id"]).collect()))
    codes = ae.ksparse_features(vectors, sent, 50, ["id"])
    assert sorted(map(tuple, ae.decode(codes, sent, vectors, ["id"]).collect())) == kept
    for block_bytes in (4000, 1500):
        monkeypatch.setattr("sparsight.operators.blocks.BLOCK_BYTES", block_bytes)
        cut = ae.SparseModel.of(weights, bias, 0)
        assert sorted(map(tuple, ae.decode(codes, cut, vectors, ["id"]).collect())) == kept
        assert sorted(map(tuple, ae.reconstruct(vectors, cut, 50, ["id"]).collect())) == kept


def nested_sum(entries, bit=ae.CODE_BITS - 1):
    """Σ along the binary tree of codes, by its definition."""
    if not entries:
        return None
    if len(entries) == 1:
        return entries[0][1]
    low = nested_sum([e for e in entries if not e[0] >> bit & 1], bit - 1)
    high = nested_sum([e for e in entries if e[0] >> bit & 1], bit - 1)
    return high if low is None else low if high is None else low + high


def test_tree_sums_follow_their_definition():
    rng = np.random.default_rng(7)
    rows, codes = np.sort(rng.integers(0, 30, 400)), rng.choice(1 << 32, 400, replace=False)
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    parts = rng.normal(size=(400, 3))
    got = ae.tree_sums(31, rows, codes, parts.copy())
    for r in range(31):
        at = np.flatnonzero(rows == r)
        wanted = nested_sum([(int(codes[i]), parts[i]) for i in at])
        np.testing.assert_array_equal(got[r], np.zeros(3) if wanted is None else wanted)


@pytest.mark.parametrize("block_bytes", [blocks.BLOCK_BYTES, 4000, 800])
def test_decoding_has_the_same_bits_in_any_number_of_blocks(spark, monkeypatch, block_bytes):
    # Features that are all multiples of 16 still spread over the blocks.
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(3)
    weights = [(16 * f, [0.0] * 8, 0.0, rng.normal(size=8).tolist()) for f in range(500)]
    frame = spark.createDataFrame(weights, "feature int, w_enc array<double>, b_enc double, w_dec array<double>")
    model = ae.SparseModel.of(frame, spark.createDataFrame([([0.5] * 8,)], "b_dec array<double>"))
    chosen = [(i, f, float(rng.normal())) for i in range(40) for f in sorted(rng.choice(500, 20, replace=False).tolist())]
    postings = spark.createDataFrame([(i, 16 * f, w) for i, f, w in chosen], "id long, feature int, weight double")
    got = {r["id"]: r.vec for r in ae.decode(postings, model, spark.range(41), ["id"]).collect()}
    w = {f: np.array(d) for f, _, _, d in weights}
    for i in range(41):
        entries = [(16 * f * ae.CODE_FACTOR % (1 << 32), v * w[16 * f]) for j, f, v in chosen if j == i]
        wanted = nested_sum(entries) if entries else np.zeros(8)
        assert got[i] == (wanted + 0.5).tolist()
