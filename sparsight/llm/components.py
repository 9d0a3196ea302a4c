"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsight.operators.skew import split_join
from sparsight.storage import materialize


#: Up to so many links a centre's neighbours are few enough for any task, and no hubs are looked for; the roots are the same.
PLAIN_LINKS = 1_000_000


def _signature(edges: DataFrame):
    mark = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(mark % 1_000_003)).first())


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) of every node of ``edges`` (a, b) with a link to another.

    Large-star and small-star steps in turn until nothing changes: each links a node's neighbours
    to the smallest of them, by a grouped minimum (summed up before it moves) and a join that splits the
    rows of centres with many neighbours, so that no neighbourhood is ever gathered in one place.  Every
    round is a written table.
    """
    stars = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = materialize(stars, "links")
    before = _signature(stars)
    while before[0]:
        hubs = {} if before[0] <= PLAIN_LINKS else None
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both.filter("v > u"), least, ["u"], hubs=hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, least, ["u"], hubs=hubs).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        after = _signature(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
