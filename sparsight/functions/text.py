"""Instructions, tokens, encoders and pooling."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsight.functions.columns import NORM_FLOOR
from sparsight.operators.blocks import list_array, matrix

# What each encoder wants in front of a query.
INSTRUCTIONS = {
    "miniCPM": "Query: ",
    "bgeBase": "Represent this sentence for searching relevant passages: ",
}

# Fixed value: tokens an encoder reads of one text.
MAX_TOKENS = 512


def apply_instruction(query: Column | str, embedding: Column | str) -> Column:
    """The query with the prefix of the named encoder; passages never get one."""
    query, embedding = (F.col(c) if isinstance(c, str) else c for c in (query, embedding))
    prefix = F.lit("")
    for name, text in INSTRUCTIONS.items():
        prefix = F.when(embedding == name, F.lit(text)).otherwise(prefix)
    return F.concat(prefix, query)


# Fixed value: what separates words, letters and digits being the words.
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), SEPARATOR, -1), lambda t: t != "")


def truncate_tokens(token_list: Column | str, n: int = MAX_TOKENS) -> Column:
    return F.slice(token_list, 1, n)


class TextEncoder(Protocol):
    """What ``embed_batches`` needs of an encoder.

    ``inputs`` prepares a text column on the JVM; ``load`` runs once per task and
    returns the function that turns a batch of those inputs into one row each.
    """

    name: str
    size: int

    def inputs(self, text: Column) -> Column: ...

    def load(self): ...


class HashedWords:
    """Hashed bag of words, scaled to unit length: the encoder that needs no model file."""

    def __init__(self, size: int = 64):
        self.name = "hashedWords"
        self.size = size

    def inputs(self, text: Column) -> Column:
        return text

    def load(self):
        size = self.size

        def bucket(word: str) -> int:
            return int(md5(word.encode()).hexdigest()[:6], 16) % size

        def encode(texts: pa.Array) -> np.ndarray:
            split = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=SEPARATOR)
            lengths = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(texts)), lengths)
            words = split.flatten().dictionary_encode()
            # Each distinct word of the batch is hashed once; empty ends are no words.
            distinct = words.dictionary.to_pylist()
            buckets = np.array([bucket(w) for w in distinct], np.int64)
            real = np.array([w != "" for w in distinct], float)
            at = words.indices.to_numpy()
            counts = np.bincount(row * size + buckets[at], weights=real[at], minlength=len(texts) * size)
            counts = counts.reshape(-1, size)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return counts / np.maximum(norm, NORM_FLOOR)

        return encode


def embed_batches(
    df: DataFrame, text: str, encoder: TextEncoder, keys: Sequence[str], batch_size: int = 512
) -> DataFrame:
    """``keys, vec`` with one float32 vector per text, ``batch_size`` texts at a time."""
    names = list(keys)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema]

    def batches(stream):
        encode = encoder.load()
        for batch in stream:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                vectors = np.asarray(encode(part.column("_input")), np.float32)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], list_array(vectors)], names=[*names, "vec"]
                )

    prepared = df.select(*names, encoder.inputs(F.col(text)).alias("_input"))
    return prepared.mapInArrow(batches, ", ".join([*fields, "vec array<float>"]))


def pool_first(token_vectors: DataFrame, key: str) -> DataFrame:
    """The vector of the first token of each text."""
    return token_vectors.groupBy(key).agg(F.min_by("vec", "pos").alias("vec"))


def pool_masked_mean(token_vectors: DataFrame, key: str) -> DataFrame:
    """Σ vector·mask / Σ mask over the tokens of each text, as ``key, vec``.

    Batches are added up per text before the shuffle, so a text with very many
    tokens arrives as few rows.
    """
    field = f"`{key}` {token_vectors.schema[key].dataType.simpleString()}"

    def partial(stream):
        for batch in stream:
            if batch.num_rows == 0:
                continue
            codes = batch.column(key).dictionary_encode()
            place = codes.indices.to_numpy()
            order = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[order], np.arange(len(codes.dictionary)))
            mask = batch.column("mask").to_numpy(zero_copy_only=False).astype(np.float64)
            weighted = matrix(batch.column("vec")) * mask[:, None]
            yield pa.RecordBatch.from_arrays(
                [codes.dictionary, list_array(np.add.reduceat(weighted[order], starts, axis=0)),
                 pa.array(np.add.reduceat(mask[order], starts))],
                names=[key, "vec", "mask"],
            )

    sums = token_vectors.select(key, "vec", "mask").mapInArrow(partial, f"{field}, vec array<double>, mask double")
    cells = sums.select(key, "mask", F.posexplode("vec").alias("dim", "x"))
    total, weight = F.sum("x"), F.sum("mask")
    # A text whose tokens are all masked has no mean.
    mean = F.when(weight != 0, total / weight).otherwise(F.lit(float("nan")))
    means = cells.groupBy(key, "dim").agg(mean.alias("x"))
    packed = F.sort_array(F.collect_list(F.struct("dim", "x")))
    return means.groupBy(key).agg(F.transform(packed, lambda s: s["x"]).alias("vec"))
