import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight.functions import columns as C
from sparsight.functions import text as X


def test_parse_count(spark):
    rows = spark.createDataFrame([("123",), ("196K",), ("2m",), ("5k",), ("3M",), ("-5K",)], "s string")
    assert [r.n for r in rows.select(C.parse_count("s").alias("n")).collect()] == [123, 196_000, 2_000_000, 5_000, 3_000_000, -5_000]


@pytest.mark.parametrize("bad", ["", "K", "12G", "1.5K", "-12", "12 K"])
def test_parse_count_refuses_the_rest(spark, bad):
    with pytest.raises(Exception, match="not a count"):
        spark.createDataFrame([(bad,)], "s string").select(C.parse_count("s").alias("n")).collect()


def test_instructions(spark):
    rows = spark.createDataFrame([("q", "miniCPM"), ("q", "bgeBase"), ("q", "other")], "q string, e string")
    got = [r.t for r in rows.select(X.apply_instruction("q", "e").alias("t")).collect()]
    assert got == ["Query: q", "Represent this sentence for searching relevant passages: q", "q"]


def test_tokens_and_truncation(spark):
    row = spark.createDataFrame([("Été, 2 fois—l'an! " + "x " * 600,)], "t string").select(
        X.tokens("t").alias("all"), X.truncate_tokens(X.tokens("t")).alias("cut")
    ).first()
    assert row["all"][:5] == ["été", "2", "fois", "l", "an"] and len(row["all"]) == 605
    assert row.cut == row["all"][:512]


def test_hashed_words_are_unit_vectors_of_counts(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "B a, A"), (3, "..."), (4, "")], "id long, t string")
    vecs = {r.id: np.array(r.vec) for r in X.embed_batches(rows, "t", X.HashedWords(16), ["id"]).collect()}
    assert np.array_equal(vecs[1], vecs[2])
    assert abs(np.linalg.norm(vecs[1]) - 1) < 1e-6
    assert not vecs[3].any() and not vecs[4].any()


def length_encoder():
    class LengthEncoder:
        """A stand-in model: text length and first code point."""

        name, size = "length", 2

        def inputs(self, text):
            return text

        def load(self):
            return lambda batch: [[len(t), ord(t[0])] for t in batch.to_pylist()]

    return LengthEncoder()


@pytest.mark.parametrize("batch", [1, 3, 512])
def test_any_encoder_plugs_in(spark, batch):
    rows = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(10)], "id long, t string").repartition(3)
    df = X.embed_batches(rows, "t", length_encoder(), ["id"], batch)
    assert dict(df.dtypes)["vec"] == "array<float>"
    assert {r.id: r.vec for r in df.collect()} == {i: [i + 1.0, 120.0] for i in range(10)}


def tokens_frame(spark):
    return spark.createDataFrame(
        [(1, 2, [3.0, 4.0], 1), (1, 1, [1.0, 2.0], 1), (1, 3, [9.0, 9.0], 0), (2, 1, [5.0, 5.0], 0)],
        "id long, pos long, vec array<double>, mask int",
    )


def test_pooling(spark):
    assert {r.id: r.vec for r in X.pool_first(tokens_frame(spark), "id").collect()} == {1: [1.0, 2.0], 2: [5.0, 5.0]}
    means = {r.id: r.vec for r in X.pool_masked_mean(tokens_frame(spark), "id").collect()}
    assert means[1] == [2.0, 3.0]
    assert np.isnan(means[2]).all()


def test_one_text_with_most_tokens(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("id"), F.lit(0).alias("pos"),
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"), F.lit(1).alias("mask"),
    ).repartition(7)
    means = {r.id: r.vec for r in X.pool_masked_mean(rows, "id").collect()}
    ids = np.arange(5000)
    assert len(means) == 501
    assert means[0][0] == pytest.approx(ids[ids % 10 < 9].mean())


def test_normalize(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r.u for r in rows.select(C.l2_normalize("v").alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_densify(spark):
    rows = spark.createDataFrame([({1: 2.0, 3: 0.5},)], "f map<int,double>")
    assert rows.select(C.densify("f", 5).alias("v")).first().v == [0.0, 2.0, 0.0, 0.5, 0.0]
