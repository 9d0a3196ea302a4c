"""From documents to packed sequences: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last
return the columns of ``documents``; ``n_chars`` follows the text.  ``run`` writes each stage as Parquet
into the shared folder and reads it again as the next one's input.

* quality: rejected documents go, and so do the lines that failed in the others;
* lines: lines of at least 40 characters found in 5 documents stay in the one with the largest id;
* near_duplicates: of each group of near copies (a Jaccard similarity of the sets of five-word shingles
  of at least 0.8, of pairs found by the fingerprints and pivots of op1, and by MinHash bands) the smallest id stays;
* decontamination: contaminated documents go, and the passages of test items in the others;
* packing: pieces of the rest, placed in sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common, decontamination, line_dedup, packing, quality_rules, simhash
from sparsight.storage import materialize


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, as the length of the text that is left."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(quality_rules.clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The workers have served other stages before: a smaller word cache.
    return packing.packed_documents(docs, cache_words=200_000)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Near copies and tokenised packing have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
