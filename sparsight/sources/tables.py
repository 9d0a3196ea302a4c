"""The table layout of a corpus below one base folder, and how to read and write it.

    passages/shard=<i>            row_idx, pid, passage
    queries/split=<s>             row_idx, qid, query
    passage_vectors/<emb>/shard=<i>           row_idx, pid, vec
    query_vectors/<emb>/split=<s>/shard=<i>   row_idx, qid, vec
    qrels/split=<s>               qid, pid, rel
    neighbors/<emb>/split=<s>     qid, rank, pid, score
    model/<name>/<mode>           weights, bias and fit state
    metrics, fit_history/<name>   long tables, appended
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.functions.columns import offset_of, shard_of

SPLITS = ("train", "dev", "eval")
# Bytes of text that one task should sort and write into one file.
FILE_BYTES = 256 * 1024 * 1024


def _check_split(split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return split


def _write_sharded(df: DataFrame, shards: int, path: str, outer: tuple[str, ...] = (), files: int = 1) -> None:
    """Row i goes to shard i mod n.  A shard is one sorted file, or several for large tables."""
    shard, file = shard_of("row_idx", shards), F.pmod(offset_of("row_idx", shards), F.lit(files)).cast("int")
    sharded = df.withColumn("shard", shard).withColumn("_task", shard * F.lit(files) + file)
    placed = sharded.repartitionById(shards * files, "_task").drop("_task")
    placed.sortWithinPartitions(*outer, "shard", "row_idx").write.mode("overwrite").partitionBy(*outer, "shard").parquet(path)


# --- passages, queries, vectors --------------------------------------------


def write_passages(passages: DataFrame, shards: int, base: str, files_per_shard: int | None = None) -> None:
    """Text shards; without ``files_per_shard`` as many files as leave each about ``FILE_BYTES`` of text at most."""
    rows = passages.select("row_idx", "pid", "passage")
    if files_per_shard is None:
        total = rows.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
        files_per_shard = max(1, -(-total // (shards * FILE_BYTES)))
    _write_sharded(rows, shards, f"{base}/passages", files=files_per_shard)


def scan_passages(spark: SparkSession, base: str) -> DataFrame:
    """All shards; order by ``row_idx`` where the order matters."""
    return spark.read.parquet(f"{base}/passages").select("row_idx", "pid", "passage")


def write_queries(queries: DataFrame, base: str) -> None:
    placed = queries.select("split", "row_idx", "qid", "query")
    placed.write.mode("overwrite").partitionBy("split").parquet(f"{base}/queries")


def scan_queries(spark: SparkSession, base: str, split: str) -> DataFrame:
    rows = spark.read.parquet(f"{base}/queries").filter(F.col("split") == _check_split(split))
    return rows.select("split", "row_idx", "qid", "query")


def write_vectors(
    vectors: DataFrame, shards: int, base: str, embedding: str, files_per_shard: int = 1
) -> None:
    """Passage vectors (``row_idx, pid, vec``) as float32 shards."""
    floats = vectors.select("row_idx", "pid", F.col("vec").cast("array<float>").alias("vec"))
    _write_sharded(floats, shards, f"{base}/passage_vectors/{embedding}", files=files_per_shard)


def scan_vectors(spark: SparkSession, base: str, embedding: str) -> DataFrame:
    rows = spark.read.parquet(f"{base}/passage_vectors/{embedding}")
    return rows.select("row_idx", "pid", "vec")


def write_query_vectors(
    vectors: DataFrame, shards: int, base: str, embedding: str, files_per_shard: int = 1
) -> None:
    """Query vectors (``split, row_idx, qid, vec``) as float32 shards per split."""
    floats = vectors.select("split", "row_idx", "qid", F.col("vec").cast("array<float>").alias("vec"))
    _write_sharded(floats, shards, f"{base}/query_vectors/{embedding}", ("split",), files_per_shard)


def scan_query_vectors(spark: SparkSession, base: str, embedding: str, split: str) -> DataFrame:
    rows = spark.read.parquet(f"{base}/query_vectors/{embedding}")
    return rows.filter(F.col("split") == _check_split(split)).select("split", "row_idx", "qid", "vec")


# --- judgments and neighbours ----------------------------------------------


def write_qrels(qrels: DataFrame, base: str) -> None:
    placed = qrels.select("split", "qid", "pid", "rel")
    placed.write.mode("overwrite").partitionBy("split").parquet(f"{base}/qrels")


def scan_relevance(spark: SparkSession, base: str, split: str) -> DataFrame:
    rows = spark.read.parquet(f"{base}/qrels").filter(F.col("split") == _check_split(split))
    return rows.select("split", "qid", "pid", "rel")


def write_neighbors(neighbors: DataFrame, base: str, embedding: str) -> None:
    placed = neighbors.select("split", "qid", "rank", "pid", "score")
    placed.write.mode("overwrite").partitionBy("split").parquet(f"{base}/neighbors/{embedding}")


def scan_neighbors(spark: SparkSession, base: str, embedding: str, split: str) -> DataFrame:
    rows = spark.read.parquet(f"{base}/neighbors/{embedding}")
    return rows.filter(F.col("split") == _check_split(split)).select(
        "split", "qid", "rank", "pid", "score"
    )


# --- reports ---------------------------------------------------------------


def write_metrics(metrics: DataFrame, base: str) -> None:
    """Save ``config, measure, value`` rows; those of a configuration replace what it had."""
    placed = metrics.select("config", "measure", "value").repartition("config")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config").parquet(
        f"{base}/metrics"
    )


def write_fit_history(history: DataFrame, base: str, name: str) -> None:
    """Save ``epoch, name, value`` rows of one model; those of an epoch replace what it had."""
    placed = history.select("epoch", "name", "value").repartition("epoch")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(
        f"{base}/fit_history/{name}"
    )


def scan_metrics(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.read.schema("config string, measure string, value double").parquet(f"{base}/metrics")
    return rows.select("config", "measure", "value")


def scan_fit_history(spark: SparkSession, base: str, name: str) -> DataFrame:
    rows = spark.read.schema("epoch int, name string, value double").parquet(f"{base}/fit_history/{name}")
    return rows.select("epoch", "name", "value")


# --- snapshots -------------------------------------------------------------


def write_model(snapshot: DataFrame, state: DataFrame, base: str, name: str, mode: str, epoch: int) -> None:
    """Save a snapshot and its one-row fit state under ``last`` or ``best``.

    Every save has a folder of its own, also one of an epoch that was saved before; the pointer row that
    names it is appended last, so a reader never meets a half-written model, a stopped save leaves the
    model before it, and a snapshot may be saved that was made from the stored one.
    """
    root = f"{base}/model/{name}"
    folder = f"{root}/epochs/{mode}-{epoch:06d}-{uuid.uuid4().hex[:12]}"
    snapshot.write.parquet(f"{folder}/weights")
    state.write.parquet(f"{folder}/state")
    spark = snapshot.sparkSession
    newest = _newest_model(spark, base, name, mode)
    turn = newest.turn + 1 if newest is not None else 0
    pointer = spark.range(1).select(
        F.lit(epoch).alias("epoch"), F.lit(turn).cast("bigint").alias("turn"), F.lit(folder).alias("folder")
    )
    pointer.write.mode("append").parquet(f"{root}/{mode}")


def _newest_model(spark: SparkSession, base: str, name: str, mode: str):
    """The pointer of the newest epoch, and of its saves the last one."""
    try:
        pointers = spark.read.schema("epoch int, turn bigint, folder string").parquet(f"{base}/model/{name}/{mode}")
    except AnalysisException:
        return None
    return pointers.select("epoch", F.coalesce("turn", F.lit(-1)).alias("turn"), "folder").orderBy(F.desc("epoch"), F.desc("turn")).first()


def scan_model(spark: SparkSession, base: str, name: str, mode: str) -> tuple[DataFrame, DataFrame] | None:
    """Snapshot and fit state of the newest ``last`` or ``best``, None when there is none."""
    if mode not in ("last", "best"):
        raise ValueError(f"unknown mode {mode!r}")
    newest = _newest_model(spark, base, name, mode)
    if newest is None:
        return None
    return spark.read.parquet(f"{newest.folder}/weights"), spark.read.parquet(f"{newest.folder}/state")
