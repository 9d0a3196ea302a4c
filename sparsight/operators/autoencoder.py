"""k-sparse autoencoder over vector tables.

``weights`` has one row per feature: ``feature INT, w_enc ARRAY<DOUBLE>, b_enc
DOUBLE, w_dec ARRAY<DOUBLE>``; the decoder bias is one more vector.  A model whose
size is below a checked bound is broadcast to the executors and vectors are never
shuffled; a larger one is cut into feature blocks that meet the vectors in cells.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.functions.columns import as_doubles, subtract
from sparsight.operators.blocks import (
    SCRATCH,
    blocks_for,
    cogroup_cells,
    key_codes,
    inner_topk,
    left_blocks_for,
    list_array,
    matrix,
    row_block,
    top_products,
)
from sparsight.storage import materialize

# Largest model, in bytes of encoder plus decoder, that is broadcast by default.
BROADCAST_BYTES = 256 * 1024 * 1024
# Decoded vectors are added up in a binary tree over codes of this many bits; a code is a feature times
# an odd number, so features have different codes and spread evenly over the tree.
CODE_BITS, CODE_FACTOR = 32, 2_654_435_769
# Bytes of one activation, and of one code, in a cell.
ACTIVATION_BYTES, CODE_BYTES = 24, 24
# Start weights that one task makes, about.
TASK_WEIGHTS = 1 << 20


@dataclass(frozen=True)
class SparseModel:
    """A weight table, its decoder bias, and its measured size."""

    weights: DataFrame
    b_dec: tuple[float, ...]
    size: int
    dim: int
    broadcast_bytes: int = BROADCAST_BYTES

    @staticmethod
    def of(weights: DataFrame, dec_bias: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> "SparseModel":
        """Check the shapes and read the one-row decoder bias."""
        size, least, most, decoder = weights.agg(
            F.count("*"),
            F.min(F.size("w_enc")),
            F.max(F.size("w_enc")),
            F.max(F.size("w_dec")),
        ).first()
        bias = dec_bias.first()
        if not size or bias is None or not least == most == decoder == len(bias.b_dec):
            raise ValueError("weights and decoder bias differ in width")
        return SparseModel(weights, tuple(float(b) for b in bias.b_dec), size, most, broadcast_bytes)

    @property
    def bytes(self) -> int:
        return 16 * self.size * self.dim

    def fits_broadcast(self) -> bool:
        return self.bytes <= self.broadcast_bytes

    @functools.cached_property
    def arrays(self):
        """The ``ModelArrays`` fields, in feature order, as one size-checked broadcast."""
        if not self.fits_broadcast():
            raise ValueError(f"model of {self.bytes} bytes is over the broadcast bound")
        table = self.weights.select("feature", "w_enc", "b_enc", "w_dec").toArrow().sort_by("feature")
        parts = (
            table["feature"].to_numpy().astype(np.int32),
            matrix(table["w_enc"]),
            table["b_enc"].to_numpy().astype(np.float64),
            matrix(table["w_dec"]),
            np.array(self.b_dec),
        )
        return self.weights.sparkSession.sparkContext.broadcast(parts)

    def release(self) -> None:
        """Removes the broadcast, if there is one; nothing that uses it may still run."""
        sent = self.__dict__.pop("arrays", None)
        if sent is not None:
            sent.destroy()


@dataclass(frozen=True)
class ModelArrays:
    """A broadcast model inside a task."""

    feature: np.ndarray
    w_enc: np.ndarray
    b_enc: np.ndarray
    w_dec: np.ndarray
    b_dec: np.ndarray

    def codes(self, x: np.ndarray, k: int, centred: bool):
        """Positive top-k codes in (row, feature) order: rows, weight positions, values."""
        shifted = x - self.b_dec if centred else x
        rows, cols, values, _ = top_products(shifted, self.w_enc, self.b_enc, k)
        keep = values > 0
        rows, cols, values = rows[keep], cols[keep], values[keep]
        order = np.lexsort((cols, rows))
        return rows[order], cols[order], values[order]

    def decode(self, n: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> np.ndarray:
        return decode_rows(n, rows, cols, values, self.w_dec, self.feature) + self.b_dec


def tree_sums(n: int, rows: np.ndarray, codes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Σ of the parts of each row along the binary tree over codes; entries are in (row, code) order.

    Two parts are added where their codes part ways, deeper ones first.  Which parts meet where depends on
    the codes alone, so the sums of any branches, added up in the tree above them, have the same bits.
    ``parts`` is used up.
    """
    out = np.zeros((n, parts.shape[1]))
    held = np.arange(len(rows))
    while True:
        # The bit in which neighbours of one row differ first; the deepest such bits are merged next.
        same = np.flatnonzero(rows[held[1:]] == rows[held[:-1]])
        if not len(same):
            break
        differ = codes[held[same]] ^ codes[held[same + 1]]
        bit = np.frexp(differ.astype(np.float64))[1]
        # Of a run of neighbours only those merge now whose bit is below the bits on both sides.
        before, after = np.full(len(same), 99), np.full(len(same), 99)
        touching = same[1:] == same[:-1] + 1
        before[1:][touching], after[:-1][touching] = bit[:-1][touching], bit[1:][touching]
        now = same[(bit < before) & (bit < after)]
        parts[held[now]] += parts[held[now + 1]]
        left = np.ones(len(held), bool)
        left[now + 1] = False
        held = held[left]
    out[rows[held]] = parts[held]
    return out


def decode_rows(
    n: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, w_dec: np.ndarray, feature: np.ndarray
) -> np.ndarray:
    """Σ value · decoder column per row, added up in the tree over the features' codes.

    Entries have ascending rows; a row has each feature once.
    """
    dim = w_dec.shape[1]
    out = np.zeros((n, dim))
    codes = feature[cols].astype(np.int64) * CODE_FACTOR % (1 << CODE_BITS)
    order = np.lexsort((codes, rows))
    rows, cols, values, codes = rows[order], cols[order], values[order], codes[order]
    counts = np.cumsum(np.bincount(rows, minlength=n))
    start = 0
    while start < n:
        # Rows whose parts fit the scratch size, one at least.
        done = counts[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(counts, done + SCRATCH // max(dim, 1), side="right")))
        at = slice(done, counts[stop - 1])
        out[start:stop] = tree_sums(stop - start, rows[at] - start, codes[at], values[at, None] * w_dec[cols[at]])
        start = stop
    return out


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]


# --- weights ---------------------------------------------------------------


def hashed_uniform(label: Column, bound: float) -> Column:
    """A repeatable uniform number in [-bound, bound) from a text label."""
    bucket = F.conv(F.substring(F.md5(label), 1, 6), 16, 10).cast("bigint")
    return (bucket / F.lit(16777216.0) - F.lit(0.5)) * F.lit(2.0 * bound)


def init_weights(features: DataFrame, dim: int, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Start weights for the given ``feature`` rows, uniform in ±1/√fan-in.

    ``size`` is the number of features, the fan-in of the decoder.  The values
    depend only on (seed, feature, dimension), so any executor makes the same ones.
    A feature is a few bytes and its vectors are many: features are dealt to tasks by what they become.
    """
    tasks = math.ceil(size * dim / TASK_WEIGHTS)
    features = features.repartition(tasks) if tasks > 1 else features
    enc, dec = dim**-0.5, size**-0.5

    def vector(name: str, bound: float, row: Column) -> Column:
        prefix = F.concat(F.lit(f"{seed}:{name}:"), row.cast("string"), F.lit(":"))
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda d: hashed_uniform(F.concat(prefix, d.cast("string")), bound),
        )

    feature = F.col("feature")
    weights = features.select(
        feature.cast("int").alias("feature"),
        vector("w_enc", enc, feature).alias("w_enc"),
        hashed_uniform(F.concat(F.lit(f"{seed}:b_enc:"), feature.cast("string")), enc).alias("b_enc"),
        vector("w_dec", dec, feature).alias("w_dec"),
    )
    bias = features.sparkSession.range(1).select(vector("b_dec", dec, F.lit(0)).alias("b_dec"))
    return weights, bias


# --- transforms ------------------------------------------------------------


def encode(vectors: DataFrame, model: SparseModel, keys: Sequence[str]) -> DataFrame:
    """All activations ``W_e x + b_e`` without centring: ``keys, feature, activation``."""
    rhs = model.weights.select("feature", "w_enc", "b_enc")
    feature_blocks = blocks_for(model.size, 8 * model.dim)
    lhs = vectors.select(*keys, "vec")
    rows = lhs.count()
    # A cell gives a key, a feature and a number for each of its pairs.
    made = ACTIVATION_BYTES * math.ceil(model.size / feature_blocks)
    row_blocks = left_blocks_for(
        rows, max(8 * model.dim, made), feature_blocks, float(rows) * model.size * model.dim,
        vectors.sparkSession.sparkContext.defaultParallelism,
    )

    def cell(lhs: pa.Table, rhs: pa.Table) -> pa.Table:
        x, w = matrix(lhs["vec"]), matrix(rhs["w_enc"])
        n, m = len(x), len(w)
        values = x @ w.T + rhs["b_enc"].to_numpy() if n and m else np.empty((n, m))
        taken = lhs.select(list(keys)).take(pa.array(np.repeat(np.arange(n), m)))
        feature = np.tile(rhs["feature"].to_numpy(), n).astype(np.int32)
        return pa.table([*taken.columns, pa.array(feature), pa.array(values.reshape(-1))],
                        names=[*keys, "feature", "activation"])

    schema = ", ".join([*_key_fields(vectors, keys), "feature int", "activation double"])
    return cogroup_cells(
        lhs, rhs, row_block(keys, row_blocks), row_block(["feature"], feature_blocks),
        row_blocks, feature_blocks, cell, schema,
    )


def center(vectors: DataFrame, model: SparseModel) -> DataFrame:
    """``vec`` minus the decoder bias."""
    return vectors.withColumn("vec", subtract("vec", list(model.b_dec)))


def _postings(vectors: DataFrame, model: SparseModel, k: int, keys: Sequence[str], centred: bool) -> DataFrame:
    schema = ", ".join([*_key_fields(vectors, keys), "feature int", "weight double"])
    if not model.fits_broadcast():
        source = center(vectors, model) if centred else vectors
        hits = inner_topk(source, model.weights, k, keys, "feature", "vec", "w_enc", bias="b_enc")
        return hits.filter(F.col("score") > 0).select(*keys, "feature", F.col("score").alias("weight"))
    arrays = model.arrays
    names = list(keys)

    def batches(stream):
        for batch in stream:
            held = ModelArrays(*arrays.value)
            rows, cols, values = held.codes(matrix(batch.column("vec")), k, centred)
            taken = batch.select(names).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(held.feature[cols]), pa.array(values)],
                names=[*names, "feature", "weight"],
            )

    return vectors.select(*names, "vec").mapInArrow(batches, schema)


def ksparse_features(vectors: DataFrame, model: SparseModel, k: int, keys: Sequence[str]) -> DataFrame:
    """Centred codes: the k largest activations of ``x − b_d``, positive ones kept."""
    return _postings(vectors, model, k, keys, centred=True)


def latent_postings(vectors: DataFrame, model: SparseModel, k: int, keys: Sequence[str]) -> DataFrame:
    """Uncentred codes, the ones that are indexed and searched."""
    return _postings(vectors, model, k, keys, centred=False)


def decode(postings: DataFrame, model: SparseModel, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``W_d f + b_d`` for every row of ``ids``; an id without features gives ``b_d``."""
    names = list(keys)
    # Every id gets a row without a feature, so that it has at least one partial sum.
    lhs = ids.select(*names, F.lit(-1).alias("feature"), F.lit(0.0).alias("weight")).unionByName(
        postings.select(*names, F.col("feature").cast("int").alias("feature"), "weight")
    )
    rhs = model.weights.select(F.col("feature").alias("w_feature"), "w_dec")
    # Blocks are whole branches of the tree of sums.
    bits = (blocks_for(model.size, 8 * model.dim) - 1).bit_length()
    feature_blocks = 1 << bits
    rows, codes = lhs.agg(F.count_if(F.col("feature") < 0), F.count("*")).first()
    row_blocks = max(
        left_blocks_for(
            rows, 8 * model.dim, feature_blocks, 64.0 * rows * model.dim,
            ids.sparkSession.sparkContext.defaultParallelism,
        ),
        blocks_for(codes // feature_blocks, CODE_BYTES),
    )
    bias = np.array(model.b_dec)

    def cell(lhs: pa.Table, rhs: pa.Table) -> pa.Table:
        if lhs.num_rows == 0:
            empty = [pa.array([], pa.list_(pa.float64())), pa.array([], pa.int32())][: 1 + (feature_blocks > 1)]
            return pa.table([*lhs.select(names).columns, *empty], names=[*names, "vec", "block"][: len(names) + len(empty)])
        # Rows in (id, feature) order; the row that only names an id comes first.
        key = key_codes(lhs, names)
        feature = lhs["feature"].to_numpy()
        order = np.lexsort((feature, key))
        key, feature, weight = key[order], feature[order], lhs["weight"].to_numpy()[order]
        first = np.r_[True, key[1:] != key[:-1]]
        rows = np.cumsum(first) - 1
        groups = lhs.select(names).take(pa.array(order[first]))
        count = groups.num_rows
        rhs = rhs.sort_by("w_feature")
        real = np.flatnonzero(feature >= 0)
        cols = np.searchsorted(rhs["w_feature"].to_numpy(), feature[real])
        held = rhs["w_feature"].to_numpy()
        block = (int(held[0]) * CODE_FACTOR % (1 << CODE_BITS)) >> (CODE_BITS - bits) if len(held) else 0
        out = decode_rows(count, rows[real], cols, weight[real], matrix(rhs["w_dec"]).reshape(-1, len(bias)), held)
        if feature_blocks == 1:
            return pa.table([*groups.columns, list_array(out + bias)], names=[*names, "vec"])
        number = pa.array(np.full(count, block, np.int32))
        return pa.table([*groups.columns, list_array(out), number], names=[*names, "vec", "block"])

    schema = ", ".join([*_key_fields(ids, names), "vec array<double>", *(["block int"] if feature_blocks > 1 else [])])

    def branch(feature: str) -> Column:
        code = F.pmod(F.col(feature).cast("bigint") * CODE_FACTOR, F.lit(1 << CODE_BITS))
        return F.when(F.col(feature) < 0, 0).otherwise(F.shiftright(code, CODE_BITS - bits)).cast("int")

    partial = cogroup_cells(
        lhs, rhs,
        (row_block(names, row_blocks), branch("feature")),
        branch("w_feature"),
        row_blocks, feature_blocks, cell, schema, replicate_left=False,
    )
    if feature_blocks == 1:
        return partial
    # At most one partial vector per feature block, and per feature, of an id; the tree above the blocks is added here.
    parts = F.sort_array(F.collect_list(F.struct("block", "vec")))
    sums = partial.groupBy(*names).agg(parts.alias("parts")).select(*names, F.col("parts.block").alias("block"), F.col("parts.vec").alias("vec"))

    def merged(stream):
        for batch in stream:
            n = batch.num_rows
            if n:
                lengths = batch.column("block").value_lengths().to_numpy(zero_copy_only=False)
                blocks = batch.column("block").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                total = tree_sums(n, np.repeat(np.arange(n), lengths), blocks, matrix(batch.column("vec").flatten()).copy())
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, list_array(total + bias)], names=[*names, "vec"])

    return sums.mapInArrow(merged, ", ".join([*_key_fields(ids, names), "vec array<double>"]))


def reconstruct(vectors: DataFrame, model: SparseModel, k: int, keys: Sequence[str]) -> DataFrame:
    """Codes, then decode: ``keys, vec`` with the reconstructed vector."""
    names = list(keys)
    if not model.fits_broadcast():
        return decode(ksparse_features(vectors, model, k, names), model, vectors, names)
    arrays = model.arrays

    def batches(stream):
        for batch in stream:
            x = matrix(batch.column("vec"))
            held = ModelArrays(*arrays.value)
            out = held.decode(len(x), *held.codes(x, k, centred=True))
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, list_array(out)], names=[*names, "vec"])

    schema = ", ".join([*_key_fields(vectors, names), "vec array<double>"])
    return vectors.select(*names, "vec").mapInArrow(batches, schema)


def codes_and_reconstruction(
    vectors: DataFrame, model: SparseModel, k: int, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Centred codes and float32 reconstruction as written tables, each vector encoded once."""
    names = list(keys)
    if not model.fits_broadcast():
        codes = materialize(ksparse_features(vectors, model, k, names), "codes")
        hats = decode(codes, model, vectors, names)
        return codes, materialize(hats.withColumn("vec", F.col("vec").cast("array<float>")), "hats")
    arrays = model.arrays

    def batches(stream):
        for batch in stream:
            x = matrix(batch.column("vec"))
            held = ModelArrays(*arrays.value)
            rows, cols, values = held.codes(x, k, centred=True)
            hats = held.decode(len(x), rows, cols, values).astype(np.float32)
            offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(x)))].astype(np.int32)
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.ListArray.from_arrays(offsets, pa.array(held.feature[cols])),
                 pa.ListArray.from_arrays(offsets, pa.array(values)), list_array(hats)],
                names=[*names, "features", "weights", "vec"],
            )

    fields = [*_key_fields(vectors, names), "features array<int>", "weights array<double>", "vec array<float>"]
    both = materialize(vectors.select(*names, "vec").mapInArrow(batches, ", ".join(fields)), "codes-and-hats")
    codes = both.select(*names, F.explode(F.arrays_zip("features", "weights")).alias("c"))
    return (
        codes.select(*names, F.col("c.features").alias("feature"), F.col("c.weights").alias("weight")),
        both.select(*names, "vec"),
    )


def vectors_as_rows(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per component: ``keys, dim, value``."""
    return vectors.select(*keys, F.posexplode(as_doubles("vec")).alias("dim", "value"))


def feature_ids(spark: SparkSession, size: int) -> DataFrame:
    return spark.range(size).select(F.col("id").cast("int").alias("feature"))
