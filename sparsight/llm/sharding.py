"""Shards cut from a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2**bits`` levels (numbers by quantiles, so that no outlying value
empties the others' levels; keys by hash), a row gets the index of its cell on the
Hilbert curve, the rows are ordered by that index and the order is cut into runs of equal
counts.  Rows near each other in all dimensions share a shard, so that a reader prunes files
by minimum and maximum of any of them.  Only ids and metadata move; texts are not shuffled.

Defined results: a null in a dimension counts as its lowest level; a null text has size 1 and
the checksum of the empty text; equal rows take neighbouring slots in any order; an empty table
gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sparsight.llm import common
from sparsight.storage import materialize

# Most bits of a level that quantiles tell apart.
CUT_BITS = 10


def hilbert_index(levels, bits: int):
    """Positions on the Hilbert curve of the rows of ``levels`` (rows x dimensions).

    Skilling's transform: the axes are turned into the transposed index, whose bits are then
    interleaved, the first axis highest.
    """
    import numpy as np

    x = np.array(levels, dtype=np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for d in range(dims):
            set_here = (x[d] & bit) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_here, low, swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> b) & 1)
    return index


def level_of_key(column: Column, bits: int) -> Column:
    """Equal keys share a level; keys are spread by their hash."""
    return F.when(column.isNull(), 0).otherwise(F.pmod(F.xxhash64(column), F.lit(1 << bits)))


def cuts_of_numbers(df: DataFrame, numbers: Mapping[str, Column], bits: int) -> dict[str, list[float]]:
    """Quantiles that cut each column of numbers into levels of like counts, whatever single rows hold.

    One pass with mergeable summaries; at most ``2**CUT_BITS`` levels, of which further bits tell no more.
    """
    levels = 1 << min(bits, CUT_BITS)
    shares = F.array(*[F.lit(i / levels) for i in range(1, levels)])
    asked = [F.percentile_approx(c.cast("double"), shares, 40 * levels).alias(k) for k, c in numbers.items()]
    seen = df.agg(*asked).first()
    return {k: list(seen[k] or []) for k in numbers}


def with_hilbert(
    df: DataFrame, dims: Mapping[str, Column], bits: int, name: str, cuts: Mapping[str, list[float]] | None = None
) -> DataFrame:
    """Adds the curve index of the levels in ``dims``; at most 63 bits in all.

    A dimension with ``cuts`` holds numbers, whose level is the count of cuts that they reach; null is level 0.
    """
    if not dims or bits * len(dims) > 63:
        raise ValueError("between 1 and 63 bits of levels are needed")
    placed = [(cuts or {}).get(k) for k in dims]

    @F.pandas_udf("long")
    def index(values):  # a Series of equally long lists
        import numpy as np
        import pandas as pd

        if not len(values):
            return pd.Series([], dtype="int64")
        columns = np.stack(values.to_numpy()).T
        levels = [
            c if at is None else np.searchsorted(at, c, side="right") << max(bits - CUT_BITS, 0) for c, at in zip(columns, placed)
        ]
        return pd.Series(hilbert_index(np.stack(levels, axis=1), bits), dtype="int64")

    lowest = F.lit(float("-inf"))
    return df.withColumn(name, index(F.array(*[F.coalesce(c.cast("double"), lowest if k in (cuts or {}) else F.lit(0.0)) for k, c in dims.items()])))


def assign_shards(docs: DataFrame, shards: int = 16, bits: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ``rows``, shard, slot, curve index of every row of ``docs``.

    Dimensions: language, source, text size and doc_id (by hash where ids are no numbers).  The counts of the shards
    differ by one at most; ``slot`` is the place in the shard, in curve order.
    """
    text = common.text_bytes(F.col("text"))
    meta = materialize(
        docs.select(
            "doc_id", "lang", "source",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        ),
        "shard-meta",
    )
    keys = {"lang": F.col("lang"), "source": F.col("source")}
    numbers = {"size": F.col("size")}
    (numbers if isinstance(meta.schema["doc_id"].dataType, NumericType) else keys)["doc_id"] = F.col("doc_id")
    dims = {**{k: level_of_key(c, bits) for k, c in keys.items()}, **numbers}
    placed = with_hilbert(meta, dims, bits, "curve", cuts_of_numbers(meta, numbers, bits))
    ranked, rows = common.with_rank(
        placed.select("doc_id", "size", "text_crc32", "curve"),
        ["curve", "doc_id", "text_crc32", "size"], "rank", "shard-order",
    )
    least, larger = divmod(rows, shards)
    edge = larger * (least + 1)
    rank, whole = F.col("rank"), max(least, 1)
    in_larger = rank < edge
    shard = F.when(in_larger, F.floor(rank / (least + 1))).otherwise(larger + F.floor((rank - edge) / whole))
    slot = F.when(in_larger, rank % (least + 1)).otherwise((rank - edge) % whole)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Writes whole documents into one folder per shard, in slot order; doc_id must be unique."""
    place = assigned.select("doc_id", "shard", "slot")
    shard = common.fresh_name(docs.columns, "shard")
    slot = common.fresh_name([*docs.columns, shard], "slot")
    rows = docs.join(place.toDF("doc_id", shard, slot), "doc_id")
    rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op7_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    return assign_shards(common.table(spark, sf, "documents"))
