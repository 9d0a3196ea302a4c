"""Line formats: two-field TSV, judgments, run files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.operators.addressing import with_row_index

# Fixed value: white space, Unicode included.
SPACE = r"(?U)\s"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return with_row_index(spark.read.text(path)).withColumnRenamed("value", "line")


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{SPACE}+|{SPACE}+$", "")


def _fields(parts: Column, count: int, what: str) -> Column:
    """``parts`` when it has exactly ``count`` entries, an error otherwise."""
    problem = F.raise_error(
        F.concat(F.lit(f"{what}: expected {count} fields, found "), F.size(parts).cast("string"))
    )
    return F.when(F.size(parts) == count, parts).otherwise(problem.cast("array<string>"))


def _two_fields(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    parts = _fields(F.split(_stripped(F.col("line")), "\t", -1), 2, "tab-separated line")
    return _lines(spark, path).select("row_idx", parts.alias("parts")).select(
        "row_idx", F.col("parts")[0].alias(key), F.col("parts")[1].alias(value)
    )


def scan_passages_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx, pid, passage`` from lines of exactly two tab-separated fields."""
    return _two_fields(spark, path, "pid", "passage")


def scan_queries_tsv(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``split, row_idx, qid, query`` from one file or folder per split."""
    splits = [
        _two_fields(spark, path, "qid", "query").select(F.lit(split).alias("split"), "*")
        for split, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, splits)


def scan_qrels(spark: SparkSession, path: str, split: str) -> DataFrame:
    """``split, qid, pid, rel`` from lines ``qid _ pid rel``; the last line of a pair wins."""
    parts = _fields(F.split(_stripped(F.col("line")), rf"{SPACE}+", -1), 4, "judgment line")
    rows = _lines(spark, path).select("row_idx", parts.alias("parts")).select(
        "row_idx",
        F.col("parts")[0].alias("qid"),
        F.col("parts")[2].alias("pid"),
        F.col("parts")[3].cast("int").alias("rel"),
    )
    last = rows.groupBy("qid", "pid").agg(F.max_by("rel", "row_idx").alias("rel"))
    return last.select(F.lit(split).alias("split"), "qid", "pid", "rel")


def run_lines(run: DataFrame) -> DataFrame:
    """``qid 0 pid 0 -position 0`` per hit, position from 0 (``rank`` counts from 1)."""
    position = (F.lit(1) - F.col("rank")).cast("string")
    return run.select(
        F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), F.col("pid").cast("string"),
                    F.lit("0"), position, F.lit("0")).alias("value")
    )


def qrel_lines(qrels: DataFrame) -> DataFrame:
    """``qid 0 pid rel`` per judgment."""
    return qrels.select(
        F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), F.col("pid").cast("string"),
                    F.col("rel").cast("string")).alias("value")
    )


def export_run_file(run: DataFrame, path: str) -> None:
    run_lines(run).write.mode("overwrite").text(path)


def export_qrel_file(qrels: DataFrame, path: str) -> None:
    qrel_lines(qrels).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, key: str, value: str, path: str) -> None:
    """Two columns as tab-separated lines, in the row order of ``df``."""
    line = F.concat_ws("\t", F.col(key).cast("string"), F.col(value))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
