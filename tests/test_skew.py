"""Joins that split hub keys, with adaptive execution off."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight.operators import skew
from sparsight.operators.pairs import build_pairs
from sparsight.operators.sparse import fetch_vectors


@pytest.fixture
def plain_joins(spark):
    """No adaptive execution, no broadcast by size, 16 tasks."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_counters_keep_every_heavy_key():
    rng = np.random.default_rng(5)
    keys = np.concatenate([np.full(3000, 7), np.full(1200, -3), rng.integers(10**6, size=8000)])
    rng.shuffle(keys)
    counters = skew.Counters(40)
    for part in np.array_split(keys, 23):
        counters.add(part)
    found = dict(zip(counters.keys.tolist(), counters.counts.tolist()))
    true = Counter(keys.tolist())
    assert len(found) <= 40 and counters.rows == len(keys)
    assert all(true[k] - len(keys) / 40 <= found.get(k, 0) <= true[k] for k in true)


def sizes(df):
    """Rows per task, tasks without rows counted as 0."""
    found = dict(df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return [found.get(i, 0) for i in range(df.rdd.getNumPartitions())]


def hub_rows(spark, n=40_000):
    """Rows (qid, rank, pid): pid 5 and the null pid hold half and a fourth of them."""
    pid = F.when(F.col("id") % 4 < 2, F.lit(5)).when(F.col("id") % 4 == 2, F.lit(None)).otherwise(F.col("id") % 997).cast("bigint")
    return spark.range(n).select(F.col("id").alias("qid"), F.lit(1).alias("rank"), pid.alias("pid"))


def test_no_task_holds_a_hub(spark, plain_joins):
    left = hub_rows(spark)
    right = spark.range(997).select(F.col("id").alias("pid"), (F.col("id") * 2).alias("twice"))
    plain = left.join(right, "pid")
    assert max(sizes(plain)) > 8 * np.median(sizes(plain))
    for how in ("inner", "left"):
        got = skew.split_join(left, right, ["pid"], how)
        assert got.columns == left.join(right, "pid", how).columns
        held = sizes(got)
        assert max(held) <= 2 * np.median(held), held
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, ["pid"], how).collect()), key=str)


def test_without_hubs_the_plan_is_the_plain_one(spark, plain_joins):
    left = spark.range(20_000).select(F.col("id").alias("qid"), (F.col("id") % 5000).alias("pid"))
    assert skew.hub_slices(left, ["pid"]) == {}
    assert skew.hub_slices(left.limit(0), ["pid"]) == {}
    with pytest.raises(ValueError):
        skew.split_join(left, left, ["pid"], "full")


def test_hub_passages_in_pairs_and_fetches(spark, plain_joins):
    neighbors = hub_rows(spark, 8000).filter("pid is not null")
    passages = spark.range(997).select(F.col("id").alias("pid"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    queries = neighbors.select("qid", F.array(F.lit(0.5).cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    pairs = build_pairs(neighbors, queries, passages, 1)
    assert {(r.qid, tuple(r.pids), tuple(map(tuple, r.p_vecs))) for r in pairs.collect()} == {
        (r.qid, (r.pid,), ((float(r.pid), 1.0),)) for r in neighbors.collect()
    }
    fetched = fetch_vectors(neighbors, passages)
    held = sizes(fetched)
    assert max(held) <= 2 * np.median(held)
    assert fetched.count() == neighbors.count() and fetched.filter("vec[0] <> pid").isEmpty()


def test_a_small_side_is_sent(spark):
    small = spark.range(10).select(F.col("id").alias("pid"))
    assert skew.is_sent(small)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not skew.is_sent(small)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
