"""What the corpus operators share."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII letters, for the contracts that lower-case only A-Z.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
#: A written table up to this many bytes may be sent to every task.
SEND_BYTES = 32 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fresh_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column has it (case aside)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_bytes(text: Column) -> Column:
    """The UTF-8 of a text, empty for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def sent_if_small(written: DataFrame, row_bytes: Column) -> DataFrame:
    """A written table, marked for broadcast where its bytes, summed up, are within the bound.

    Beyond it Spark moves both sides of the join; the rows are the same.
    """
    total = written.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(written) if total <= SEND_BYTES else written


def with_rank(sorted_by: DataFrame, keys: Sequence[Column | str], rank: str, label: str) -> tuple[DataFrame, int]:
    """Adds a gapless global position (from 0) in the order of ``keys``; returns the frame and its count.

    The rows are dealt to range partitions and sorted there; the position inside a partition is
    kept in the written table, so that a repeated task cannot renumber anything.  One row per
    partition is summed up to give the partitions their starts.  Equal keys may span partitions.
    """
    from sparsight.storage import materialize

    at = fresh_name(sorted_by.columns, "at")
    dealt = sorted_by.repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = materialize(dealt.withColumn(at, F.monotonically_increasing_id()), label)
    part = F.shiftright(F.col(at), 33)
    sizes = written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("part").alias(fresh_name(sorted_by.columns, "part")),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(fresh_name(sorted_by.columns, "start")),
    )
    part_name, start_name = starts.columns
    placed = written.join(F.broadcast(starts), part == F.col(part_name), "left")
    ranked = placed.withColumn(rank, F.col(start_name) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    return ranked.drop(at, part_name, start_name), written.count()


def byte_slices(batch, column: int, most: int):
    """Cuts an Arrow batch into slices of at most ``most`` bytes of a binary column, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for rows in runs_of(range(batch.num_rows), sizes, most):
        yield batch.slice(rows[0], len(rows))


def give_back() -> None:
    """Returns what a worker has freed to the system: workers are used again, by other stages beside the JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def pieces(total: int, most: int) -> int:
    """How many blocks of at most ``most`` hold ``total``; one at least."""
    return max(1, math.ceil(total / most))


def runs_of(values: list, sizes, most: int):
    """Cuts ``values`` into consecutive lists of about ``most`` size in all, one value at least."""
    part, held = [], 0
    for value, size in zip(values, sizes):
        if part and held + size > most:
            yield part
            part, held = [], 0
        part.append(value)
        held += size
    if part:
        yield part


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
