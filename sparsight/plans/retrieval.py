"""Retrieval pipelines: reconstructed, latent, and pseudo-relevance feedback."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsight.operators.autoencoder import (
    SparseModel,
    codes_and_reconstruction,
    decode,
    ksparse_features,
    latent_postings,
    reconstruct,
)
from sparsight.operators.combined import combined_topk
from sparsight.operators.dense import dense_topk
from sparsight.operators.skew import split_join
from sparsight.operators.sparse import sparse_topk
from sparsight.storage import materialize

# Fixed values of the feedback grid.
GRID_HITS = (1, 2, 4, 8, 16, 32)
GRID_FEATURES = (1, 2, 4, 8, 16)
GRID_DELTAS = (0.04, 0.08, 0.16, 0.32, 0.64)


def _stored(vectors: DataFrame, label: str) -> DataFrame:
    """A table of vectors, float32 like the ones they come from: half the bytes to write and shuffle."""
    return materialize(vectors.withColumn("vec", F.col("vec").cast("array<float>")), label)


def retrieve_reconstructed(
    queries: DataFrame, passages: DataFrame, model: SparseModel, latent_k: int, k: int
) -> DataFrame:
    """Dense search with reconstructed vectors on both sides."""
    q_hat = _stored(reconstruct(queries, model, latent_k, ["qid"]), "q-hat")
    p_hat = _stored(reconstruct(passages, model, latent_k, ["pid"]), "p-hat")
    return dense_topk(q_hat, p_hat, k)


def retrieve_latent(
    queries: DataFrame,
    passages: DataFrame,
    model: SparseModel,
    latent_k: int,
    k: int = 100,
    query_latent_k: int | None = None,
) -> DataFrame:
    """Sparse search with uncentred codes on both sides."""
    index = latent_postings(passages, model, latent_k, ["pid"])
    query_latent_k = query_latent_k or latent_k
    asked = materialize(latent_postings(queries, model, query_latent_k, ["qid"]), "asked")
    return sparse_topk(asked, index, k)


def retrieve_latent_wide(
    queries: DataFrame, passages: DataFrame, model: SparseModel, latent_k: int, k: int = 100
) -> DataFrame:
    """The variant whose queries keep as many codes as hits are wanted."""
    return retrieve_latent(queries, passages, model, latent_k, k, query_latent_k=k)


# --- feedback --------------------------------------------------------------


def feedback_hits(q_hat: DataFrame, p_hat: DataFrame, feedback_k: int) -> DataFrame:
    """First-round hits of reconstructed queries among reconstructed passages."""
    return dense_topk(q_hat, p_hat, feedback_k)


def best_features(codes: DataFrame, alpha: int) -> DataFrame:
    """The ``alpha`` strongest features of each passage, with their place."""
    order = Window.partitionBy("pid").orderBy(F.col("weight").desc(), F.col("feature").asc())
    return codes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= alpha)


def feedback_features(hits: DataFrame, codes: DataFrame, alpha: int) -> DataFrame:
    """Strongest features of every hit: ``qid, pid, rank, feature, weight, place``.

    A passage has the same codes for every query that hits it, so ``codes`` holds
    them once per passage (from its raw vector) and is joined to the hits.
    """
    # The join reads the hits more than once; the search that finds them runs once.
    found = materialize(hits.select("qid", "pid", "rank"), "feedback-hits")
    return split_join(found, best_features(codes, alpha), ["pid"])


def feedback_union(features: DataFrame) -> DataFrame:
    """Distinct features per query over its feedback passages."""
    return features.select("qid", "feature").distinct()


def expand_query(postings: DataFrame, union: DataFrame, delta: float) -> DataFrame:
    """Add ``delta`` once to every feature of the union, present in the query or not."""
    added = union.select("qid", "feature", F.lit(float(delta)).alias("weight"))
    both = postings.select("qid", "feature", "weight").unionByName(added)
    return both.groupBy("qid", "feature").agg(F.sum("weight").alias("weight"))


class FeedbackTables:
    """What all feedback settings share, each written once.

    Queries go through the autoencoder twice: search starts from their
    reconstruction, and expansion from the codes of that reconstruction.
    """

    def __init__(self, queries: DataFrame, passages: DataFrame, model: SparseModel, latent_k: int):
        self.model = model
        self.q_hat = _stored(reconstruct(queries, model, latent_k, ["qid"]), "q-hat")
        self.p_codes, self.p_hat = codes_and_reconstruction(passages, model, latent_k, ["pid"])
        self.q_codes = materialize(ksparse_features(self.q_hat, model, latent_k, ["qid"]), "q-codes")


def retrieve_feedback(
    queries: DataFrame,
    passages: DataFrame,
    model: SparseModel,
    latent_k: int,
    feedback_k: int,
    alpha: int,
    delta: float,
    k: int,
) -> DataFrame:
    """Search, expand each query by the features of its hits, search again."""
    tables = FeedbackTables(queries, passages, model, latent_k)
    hits = feedback_hits(tables.q_hat, tables.p_hat, feedback_k)
    union = feedback_union(feedback_features(hits, tables.p_codes, alpha))
    expanded = expand_query(tables.q_codes, union, delta)
    asked = decode(expanded, model, tables.q_hat.select("qid"), ["qid"])
    return dense_topk(_stored(asked, "expanded"), tables.p_hat, k)


def feedback_grid() -> list[tuple[int, int, float]]:
    """The 136 settings (hits, features, delta).

    The largest delta is left out for the widest expansions: 16 features, or 16
    hits and more.
    """
    top = max(GRID_DELTAS)
    return [
        (hits, features, delta)
        for hits, features, delta in product(GRID_HITS, GRID_FEATURES, GRID_DELTAS)
        if delta != top or (hits < 16 and features < 16)
    ]


def config_name(hits: int, features: int, delta: float) -> str:
    return f"{hits}-{features}-{delta}"


def feedback_sweep(
    queries: DataFrame,
    passages: DataFrame,
    model: SparseModel,
    latent_k: int,
    k: int,
    grid: list[tuple[int, int, float]] | None = None,
) -> DataFrame:
    """``retrieve_feedback`` for every setting of a grid: ``config, qid, pid, score, rank``.

    The first round runs once with the most hits and features any setting asks for.
    Each (query, feature) keeps, for every number of hits in the grid, the best place
    it had among them; a setting picks the feature when that place is within its bound.
    Each query is decoded once, and once for each pair of bounds; scores of a setting come from these products.
    """
    grid = feedback_grid() if grid is None else grid
    tables = FeedbackTables(queries, passages, model, latent_k)
    levels = sorted({hits for hits, _, _ in grid})
    hits = feedback_hits(tables.q_hat, tables.p_hat, levels[-1])
    found = feedback_features(hits, tables.p_codes, max(features for _, features, _ in grid))
    best = [F.min(F.when(F.col("rank") <= level, F.col("place"))) for level in levels]
    places = found.groupBy("qid", "feature").agg(F.array(*best).alias("places"))

    # Decoding and scores are linear: a setting is the decoded query plus delta times its decoded union of features,
    # and settings with the same bounds share the union.  Bounds above the most features of a passage pick the same.
    widest = tables.p_codes.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    pairs = list(dict.fromkeys((level, min(features, widest)) for level, features, _ in grid))
    bounds = F.array(
        *[
            F.struct(
                F.lit(number).alias("number"), F.lit(levels.index(level)).alias("level"), F.lit(features).alias("features")
            )
            for number, (level, features) in enumerate(pairs)
        ]
    )
    picked = places.withColumn("b", F.explode(bounds)).filter(F.col("places")[F.col("b.level")] <= F.col("b.features"))
    unions = picked.select(F.col("b.number").alias("number"), "qid", "feature", F.lit(1.0).alias("weight"))
    ids = tables.q_hat.select("qid", F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("number"))
    unbiased = replace(model, b_dec=(0.0,) * model.dim)
    steps = decode(unions, unbiased, ids, ["number", "qid"])
    # One vector per pair of bounds and query.
    ordered = F.sort_array(F.collect_list(F.struct("number", "vec")))
    each = steps.groupBy("qid").agg(ordered.alias("s")).select("qid", F.col("s.vec").alias("steps"))
    starts = reconstruct(tables.q_hat, model, latent_k, ["qid"])
    asked = materialize(starts.join(each, "qid"), "starts-and-steps")
    settings = [(config_name(level, features, d), pairs.index((level, min(features, widest))), float(d)) for level, features, d in grid]
    return combined_topk(asked, tables.p_hat, k, ["qid"], "pid", settings)
