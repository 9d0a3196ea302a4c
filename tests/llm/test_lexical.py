"""Ranked search against scoring of every document, with and without pair lists."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.llm import lexical as X

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    """(item_id, rank, score) with ids; documents and items are rows."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, counts, n in held:
            m, score = 100 - 25 + 25 * n * n_docs // length, 0
            for t in terms_of(text):
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * counts[t] // (1000 * counts[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def ranked(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def random_docs(seed, n=700, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    text = lambda most: " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, most)))
    return [(i, text(90)) for i in range(n)], [(i, text(14)) for i in range(40)]


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(X, "SHARD_POSTINGS", 900)
    monkeypatch.setattr(X, "SHARD_DOCS", 70)


ITEMS = [
    (0, "tale7 tale60 saga60 of"), (1, "A plain LINE that many documents share, a a a"), (2, ""), (3, None), (4, "nowhere to be found zzz"),
    (5, "word3 word976 goes 29999"), (None, "漢字 É é İ"), (7, "tale7"), (7, "tale7"), (8, "b c b c"),
]


def test_awkward_rows(spark, awkward, awkward_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("row", F.lit(1)).withColumn("terms", F.lit("t"))
    assert ranked(X.rank_documents(awkward_docs, items)) == brute(awkward, ITEMS)
    assert X.rank_documents(no_docs, items).count() == 0
    assert X.rank_documents(awkward_docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [common.SEND_BYTES, 0])
def test_random_documents(spark, monkeypatch, sent, small_shards):
    # With nothing to be sent, all terms are indexed, no pair has a list and items come in many blocks.
    monkeypatch.setattr(common, "SEND_BYTES", sent)
    monkeypatch.setattr(X, "ITEM_BYTES", X.ITEM_BYTES if sent else 4000)
    docs, items = random_docs(4)
    docs += [(i, docs[i][1]) for i in range(0, 50, 7)] + [(1000 + i, docs[3][1]) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = X.rank_documents(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert ranked(got) == brute(docs, items)


def in_memory(docs, items, with_pairs, small=70):
    """Shards and chains without Spark."""
    counts = [X.term_counts((t or "").encode()) for _, t in docs]
    df = Counter(t.decode() for _, c in counts for t in c)
    n_docs, length = len(docs), sum(n for n, _ in counts)
    weights = {t: X.weight(d, n_docs) for t, d in df.items()}
    asked, pairs = [], {}
    for _, text in items:
        c = Counter(terms_of(text))
        row = type("Row", (), {"terms": sorted(c), "counts": [c[t] for t in sorted(c)]})
        terms, w, repeats = X.item_chain(row, weights)
        asked.append((terms, w, repeats))
        pairs |= {p: None for p in zip(terms, terms[1:], w, w[1:])}
    shards = []
    for at in range(0, len(docs), small):
        part = [(i, n, c) for (i, _), (n, c) in zip(docs[at : at + small], counts[at : at + small])]
        names = [sorted(t.decode() for t in c) for _, _, c in part]
        batch = pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in part]), pa.array([p[1] for p in part]), pa.array(names, pa.list_(pa.string())),
             pa.array([[p[2][t.encode()] for t in n] for p, n in zip(part, names)], pa.list_(pa.int32()))],
            names=["doc_id", "n", "terms", "counts"],
        )
        shards.append(X.with_pair_lists(X.built_shard([batch], n_docs, length), list(pairs) if with_pairs else []))
    return shards, asked


def test_pairs_skip_more_and_lose_nothing():
    docs, items = random_docs(11, 6000, 400)
    shards, asked = in_memory(docs, items, True, 2000)
    paired = X.search_shards(shards, asked, 5)
    single = X.search_shards(shards, asked, 5, use_pairs=False)
    everything = sum(len(s.posting(c)[0]) for s in shards for t, _, _ in asked for c in np.flatnonzero(np.isin(s.terms.to_pylist(), t)).tolist())
    for a, b in zip(paired, single):
        assert a.scores.tolist() == b.scores.tolist() and a.ids == b.ids
    visits = [sum(x.visited for x in found) for found in (paired, single)]
    assert visits[0] < visits[1] < everything, (visits, everything)


def test_pairing_is_the_best_one():
    rng = random.Random(2)
    for _ in range(200):
        tops = [rng.randrange(50) for _ in range(rng.randrange(1, 9))]
        joint = [None] + [rng.choice([None, max(a, b) + rng.randrange(min(a, b) + 1)]) for a, b in zip(tops, tops[1:])]

        def least(i):
            if i <= 0:
                return 0
            alone = least(i - 1) + tops[i - 1]
            return alone if joint[i - 1] is None else min(alone, least(i - 2) + joint[i - 1])

        assert X.best_pairing(tops, joint)[0] == [least(i) for i in range(len(tops) + 1)]


def test_shards_come_back_as_they_were(spark, small_shards):
    docs, items = random_docs(6, 300)
    frame = spark.createDataFrame([(str(i) if i % 9 else None, t) for i, t in docs], "doc_id string, text string")
    asked = X.item_terms(spark.createDataFrame(items, "item_id bigint, text string"))
    table = X.materialize(X.forward(frame, X.small_vocabulary(asked)), "forward")
    stats = X.statistics_of(table)
    rows = X.build_shards(table, stats, X.pairs_of(asked, stats)).toArrow().to_batches()
    shards = [X.read_shard(b, i) for b in rows for i in range(b.num_rows)]
    assert len(shards) > 3 and sum(len(s.doc_ids) for s in shards) == stats.documents
    assert any(s.pairs for s in shards) and max(len(s.docs) for s in shards) <= 900 and max(len(s.doc_ids) for s in shards) <= 70
    for s in shards:
        for (a, b), (docs_, joint) in s.pairs.items():
            assert set(docs_.tolist()) == set(s.posting(a)[0].tolist()) & set(s.posting(b)[0].tolist()) and len(joint) == len(docs_)


def test_long_texts_are_split_alike(monkeypatch):
    text = ("word " * 1000 + "x" * 5000 + "; Ünder_score9 " * 300).encode()
    whole = X.term_counts(text)
    monkeypatch.setattr(X, "SLICE", 17)
    assert X.term_counts(text) == whole and whole[0] == 1000 + 1 + 2 * 300
