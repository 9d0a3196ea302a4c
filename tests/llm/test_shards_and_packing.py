"""Hilbert shards and packed sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparsight.llm import packing as P
from sparsight.llm import sharding as H


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = H.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def check_shards(rows, docs, shards):
    assert len(rows) == len(docs)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min([sizes[s] for s in range(shards)]) <= 1 and set(sizes) <= set(range(shards))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    ordered = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )


def test_shards(spark, awkward, awkward_docs, no_docs, tmp_path):
    check_shards(H.assign_shards(awkward_docs).collect(), awkward, 16)
    check_shards(H.assign_shards(awkward_docs.limit(5), shards=16).collect(), awkward[:5], 16)
    assert H.assign_shards(no_docs).count() == 0
    unique = awkward_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    H.write_shards(unique, H.assign_shards(unique, 4), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == unique.count()
    nulls = spark.createDataFrame([(None, None, None, None)] * 20, "doc_id bigint, text string, lang string, source string")
    check_shards(H.assign_shards(nulls).collect(), [(None, None)] * 20, 16)


def test_an_outlier_leaves_the_other_levels_apart(spark):
    docs = spark.createDataFrame([(i,) for i in [*range(1000), 10**15, None]], "n bigint")
    cuts = H.cuts_of_numbers(docs, {"n": F.col("n")}, 8)["n"]
    assert cuts == [float(min(v for v in range(1000) if (v + 1) * 256 >= 1001 * i)) for i in range(1, 256)]
    placed = H.with_hilbert(docs, {"n": F.col("n")}, 8, "level", {"n": cuts}).collect()
    assert all(r.level == sum(r.n >= c for c in cuts) if r.n is not None else r.level == 0 for r in placed)
    assert max(Counter(r.level for r in placed).values()) <= 6
    few = docs.filter("n < 3")
    wide = H.with_hilbert(few, {"n": F.col("n")}, 12, "level", H.cuts_of_numbers(few, {"n": F.col("n")}, 12)).collect()
    assert all(0 <= r.level < 1 << 12 for r in wide) and len({r.level for r in wide}) == 3


def test_ids_that_are_no_numbers(spark, awkward, awkward_docs):
    named = awkward_docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    check_shards(H.assign_shards(named).collect(), [(None if i is None else f"d{i}", t) for i, t in awkward], 16)


def brute_pieces(rows, capacity):
    t = Tokenizer.from_file(P.tokenizer_path())
    out = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return Counter(out)


def check_packing(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [4096, 16])
def test_packed_documents(awkward, awkward_docs, capacity):
    pieces = P.token_pieces(awkward_docs, P.tokenizer_path(), capacity)
    rows = P.pack(pieces, capacity).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == brute_pieces(awkward, capacity)
    least = -(-sum(r.length for r in rows) // capacity)
    assert check_packing(rows, capacity) <= least + 2


def test_word_cache_equals_whole_texts(monkeypatch):
    from sparsight.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    rng = random.Random(2)
    parts = ["The", "the", "the.", "cat,", "Über", "ÜBER.", "ß", "it's", "don't.", "12.5", "a.b", "...", "é,", "é", "İx", "Σς", "漢字",
             "<|endoftext|>", "x<|startoftext|>", " ", " ", "\x1c", "!!", "\U0001f600.", ".", ",", "ab.,", "ﬁ", "́", "ŉ"]
    texts = [rng.choice(["", " ", "\n"]).join("") + " ".join(rng.choices(parts, k=rng.randrange(30))) + rng.choice(["", " ", "\n\t"]) for _ in range(300)]
    whole = Tokenizer.from_file(P.tokenizer_path())
    cached = tokens.WordTokens(P.tokenizer_path())
    for at in range(0, 300, 50):
        some = texts[at : at + 50]
        assert cached.encode([t.encode() for t in some]) == [
            np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some
        ]


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_the_histogram_up(seed):
    rng = np.random.default_rng(seed)
    capacity = [64, 512, 4096][seed % 3]
    lengths = np.clip(rng.lognormal(np.log(capacity / [3, 1.5][seed % 2]), 0.8, 5000).astype(int), 1, capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = P.plan_packing(counts, capacity)
    used = np.zeros_like(counts)
    for members, repeats in plan:
        assert sum(members) <= capacity and repeats > 0
        np.add.at(used, list(members), repeats)
    assert (used == counts).all()
    bound = max(-(-lengths.sum() // capacity), (lengths > capacity / 2).sum())
    assert sum(r for _, r in plan) <= 1.02 * bound + 2


def test_sequences_and_nothing(awkward_docs, no_docs):
    packed = P.pack(P.token_pieces(awkward_docs, P.tokenizer_path(), 64, with_ids=True), 64)
    whole = P.sequences(packed).withColumn("n", F.octet_length("ids") / 4)
    expected = {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert {r.sequence_id: r.n for r in whole.collect()} == expected
    assert P.packed_documents(no_docs).count() == 0


def test_patterns_of_short_lengths():
    rng = np.random.default_rng(8)
    counts = np.bincount(rng.integers(20, 900, 60_000), minlength=4097)
    assert P.fitted_share(counts) > 0.5
    plan = P.plan_packing(counts, 4096)
    used = np.zeros_like(counts)
    for members, repeats in plan:
        assert sum(members) <= 4096
        np.add.at(used, np.array(members), repeats)
    assert (used == counts).all()
    lengths = int((np.arange(4097) * counts).sum())
    assert sum(r for _, r in plan) <= 1.01 * lengths / 4096 + 1


def test_the_word_cache_is_bounded_by_bytes():
    from sparsight.llm import tokens as T

    cached = T.WordTokens(P.tokenizer_path())
    cached.most = 300
    texts = [("漢字" * 1000 + str(i)).encode() for i in range(40)] + [" ".join(f"word{j}x{i}" for j in range(60)).encode() for i in range(60)]
    expected = cached.ids([t.decode() for t in texts])
    for text, ids in zip(texts, expected):
        assert cached.encode([text]) == [ids]
        held = sum(len(w) + len(i) + T.ENTRY_BYTES for w, i in cached.known.items())
        # One call may add its words before the cache starts anew; long words are never held.
        assert held == cached.bytes <= 300 * T.WORD_BYTES + 70 * 400 and all(len(w) <= T.LONGEST_WORD for w in cached.known)
