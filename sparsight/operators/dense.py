"""Exact dense search by inner product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsight.operators.blocks import inner_topk


def dense_topk(queries: DataFrame, passages: DataFrame, k: int, keys=("qid",)) -> DataFrame:
    """k best passages per query: ``keys, pid, score, rank``.

    ``queries`` has the key columns and ``vec``, ``passages`` has ``pid, vec``.
    """
    return inner_topk(queries, passages, k, keys, "pid", "vec", "vec")


def dense_topk_sharded(
    queries: DataFrame, passages: DataFrame, k: int, query_blocks: int, passage_blocks: int
) -> DataFrame:
    """``dense_topk`` with a chosen grid; partial results of the passage blocks are merged."""
    return inner_topk(
        queries, passages, k, ["qid"], "pid", "vec", "vec",
        left_blocks=query_blocks, right_blocks=passage_blocks,
    )


def dense_add(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Append vectors to an index table; their ``row_idx`` goes on after its last row.

    ``index`` and ``vectors`` both have ``row_idx, pid, vec``.
    """
    last = index.agg(F.max("row_idx")).first()[0]
    shift = 0 if last is None else last + 1
    return index.unionByName(vectors.withColumn("row_idx", F.col("row_idx") + F.lit(shift)))


def neighbor_join(queries: DataFrame, passages: DataFrame, split: str, k: int) -> DataFrame:
    """Exact neighbours of every query of a split: ``split, qid, rank, pid, score``."""
    hits = dense_topk(queries, passages, k)
    return hits.select(F.lit(split).alias("split"), "qid", "rank", "pid", "score")


def hits_as_arrays(hits: DataFrame, keys=("qid",)) -> DataFrame:
    """Per query the ids and the scores, best first, as two arrays."""
    packed = hits.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rank", "pid", "score"))).alias("hits")
    )
    return packed.select(*keys, F.col("hits.pid").alias("pids"), F.col("hits.score").alias("scores"))
