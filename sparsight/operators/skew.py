"""Equi-joins whose hub keys are found by a sketch and split, whatever adaptive execution does.

A hub is a key that holds more rows than a task should take.  Hubs are found by a Misra-Gries
summary: every task of one narrow pass over the keys keeps a bounded number of counters, the tasks'
counters are added up, and what may still exceed the bound is a hub.  Left rows of a hub are dealt
to several slices by a hash of the row, right rows of a hub are copied to each slice, and all other
rows go to slice 0; one join on (key, slice) gives the rows of the plain join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsight.storage import materialize

#: A key is a hub when it has more than this part of an average task's rows.
HUB_PART = 0.5
#: Slices for as many rows of a hub as an average task has; many small slices fall evenly on the tasks.
SLICES = 16


class Counters:
    """Misra-Gries counters of 64-bit keys: every key with more than rows / size of the rows has one.

    A counter is at most the key's number of rows, and less by no more than rows / size.
    """

    def __init__(self, size: int):
        self.size, self.rows = size, 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        fresh, counts = np.unique(keys, return_counts=True)
        self.rows += len(keys)
        both, weights = np.concatenate([self.keys, fresh]), np.concatenate([self.counts, counts])
        self.keys, place = np.unique(both, return_inverse=True)
        self.counts = np.zeros(len(self.keys), np.int64)
        np.add.at(self.counts, place, weights)
        if len(self.keys) > self.size:
            # Taking the (size + 1)-th largest count off all takes it off size + 1 different keys.
            at = len(self.counts) - self.size - 1
            cut = np.partition(self.counts, at)[at]
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut


def key_hash(keys: Sequence[str | Column]) -> Column:
    """One number per combination of keys, nulls included."""
    return F.xxhash64(*keys)


def hub_slices(frame: DataFrame, keys: Sequence[str | Column], partitions: int | None = None) -> dict[int, int]:
    """Hash of each hub key of ``frame`` and the number of slices its rows are worth.

    ``partitions`` is the number of tasks a join deals its rows to (by default the session's).  At most
    4 / HUB_PART * ``partitions`` keys come back, with a few times SLICES * ``partitions`` slices in all; so the
    answer is bounded by the number of tasks, not by the data.
    """
    partitions = partitions or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = math.ceil(4 * partitions / HUB_PART)

    def sketch(stream):
        counters = Counters(size)
        for batch in stream:
            counters.add(batch.column(0).to_numpy())
        # Key 0 once more, with the number of rows of the task.
        keys, counted = np.r_[counters.keys, 0], np.r_[counters.counts, 0]
        rows = np.zeros(len(keys), np.int64)
        rows[-1] = counters.rows
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counted), pa.array(rows)], names=["key", "counted", "rows"])

    narrow = frame.select(key_hash(keys).alias("key"))
    parts = materialize(narrow.mapInArrow(sketch, "key bigint, counted bigint, rows bigint"), "counters")
    share = (parts.agg(F.sum("rows")).first()[0] or 0) / partitions
    # Counters are low by at most 1 / size of the rows: a fourth of the bound for a hub.
    hubs = parts.groupBy("key").agg(F.sum("counted").alias("counted")).filter(F.col("counted") > 0.75 * HUB_PART * share)
    return {r.key: math.ceil(SLICES * r.counted / share) + 1 for r in hubs.collect()} if share else {}


def is_sent(frame: DataFrame) -> bool:
    """Whether Spark, by its own bound and estimate, sends this side of a join to all tasks."""
    bound = frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return bound > 0 and int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= bound


def split_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hubs: dict[int, int] | None = None
) -> DataFrame:
    """``left.join(right, on, how)`` (inner or left) with the rows of hub keys of ``left`` split.

    ``right`` should have few rows per key; its rows of hub keys are copied once per slice, which adds
    a few times SLICES rows per task in all.  Left rows that are equal in all columns stay together.  ``hubs``
    are those of :func:`hub_slices` where the caller knows them; by default one pass over the keys finds them,
    unless ``right`` is small enough to be sent to all tasks.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no split join of the kind {how}")
    on = list(on)
    if hubs is None:
        hubs = {} if is_sent(right) else hub_slices(left, on)
    if not hubs:
        return left.join(right, on, how)
    spark = left.sparkSession
    taken = {c.lower() for c in (*left.columns, *right.columns)}
    key, slices, part = ("_" * max(map(len, taken)) + n for n in ("key", "slices", "part"))
    table = F.broadcast(spark.createDataFrame(list(hubs.items()), f"{key} bigint, {slices} int"))
    count = F.coalesce(F.col(slices), F.lit(1))
    # Maps have no hash; rows that differ in them alone stay together.
    others = [F.col(f"`{f.name}`") for f in left.schema if f.name not in on and "map<" not in f.dataType.simpleString()]
    dealt = F.pmod(F.xxhash64(*others, F.lit(7)), count).cast("int")
    lhs = left.withColumn(key, key_hash(on)).join(table, key, "left").withColumn(part, dealt).drop(key, slices)
    copies = F.explode(F.sequence(F.lit(0), count - 1))
    rhs = right.withColumn(key, key_hash(on)).join(table, key, "left").withColumn(part, copies).drop(key, slices)
    return lhs.join(rhs, [*on, part], how).drop(part)
