import math
from collections import Counter

import numpy as np
import pytest

from sparsight.llm import context_tree as T


def brute(train, texts, depth):
    """Context-tree weighting by dictionaries, straight from its definition."""
    counts = Counter()
    nodes = set()

    def events(text):
        raw = bytes([255]) * depth + text.lower() + b"\xff"
        for i in range(depth, len(raw)):
            for bit in range(8):
                yield raw[i - depth : i], (1 << bit) | (raw[i] >> (8 - bit)), (raw[i] >> (7 - bit)) & 1

    for text in train:
        for context, node, value in events(text):
            for d in range(depth + 1):
                counts[context[depth - d :], node, value] += 1
                nodes.add((context[depth - d :], node))
    children = {}
    for context, node in nodes:
        if context:
            children.setdefault((context[1:], node), []).append(context)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = log_kt(counts[context, node, 0], counts[context, node, 1])
            if len(context) < depth:
                below = sum(weighted(c, node) for c in children.get((context, node), ()))
                own = np.logaddexp(own, below) - math.log(2)
            memo[context, node] = own
        return memo[context, node]

    def chance(context, node, value, d=0):
        here = context[depth - d :]
        a, b = counts[here, node, 0], counts[here, node, 1]
        kt = ((b if value else a) + 0.5) / (a + b + 1)
        if d == depth:
            return kt
        share = math.exp(log_kt(a, b) - math.log(2) - weighted(here, node)) if (here, node) in nodes else 0.5
        return share * kt + (1 - share) * chance(context, node, value, d + 1)

    return [sum(math.log10(chance(c, n, v)) for c, n, v in events(t)) for t in texts]


DOCS = [
    (1, "the cat sat on the mat. The cat sat."), (2, None), (3, ""), (4, "über die Brücke, über die BRÜCKE"), (5, "the cat"),
    (6, "zq zq xj"), (7, "the cat sat on the mat. The cat sat."), (8, "a\x00b\tc " * 40), (9, "the the the"), (10, "on the mat"),
    (None, "no id"), (12, "the cat"), (12, "the cat"), (13, "Ünseen wörds 漢字"),
]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_tokens string")


@pytest.mark.parametrize("depth", [2, 3, 4])
@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force(spark, monkeypatch, depth, small):
    if small:  # heads of a few rows, so that the join has work, and several tasks
        monkeypatch.setattr(T, "HEAD_RUNS", 5)
        monkeypatch.setattr(T, "HEAD_WORDS", 2)
        monkeypatch.setattr(T, "TASK_RUNS", 20)
    docs = T.with_folds(frame(spark))
    kept = [(r.doc_id, r.held_out, bytes(r.text)) for r in docs.collect()]
    assert any(h for _, h, _ in kept) and not all(h for _, h, _ in kept)
    train = [t for _, h, t in kept if not h]
    got = T.score(docs, T.fit(docs, depth)).collect()
    expected = dict(zip([(i, t) for i, _, t in kept], brute(train, [t for *_, t in kept], depth)))
    words = Counter(w for t in train for w in [*t.lower().split(), b" "])
    total, different = sum(words.values()), len(words)
    by_row = Counter((r.doc_id, round(r.score, 6), round(r.base_score, 6), r.n_tokens, r.n_known) for r in got)
    wanted = Counter()
    for i, _, t in kept:
        tokens = [*t.lower().split(), b" "]
        base = sum(math.log10((words[w] + 1) / (total + different + 1)) for w in tokens)
        wanted[i, round(expected[i, t], 6), round(base, 6), len(tokens), sum(words[w] > 0 for w in tokens)] += 1
    assert by_row == wanted
    assert {r.train_tokens for r in got} == {total}


def test_no_rows_and_no_training(spark):
    empty = T.with_folds(frame(spark, []))
    assert T.score(empty, T.fit(empty)).count() == 0
    held = T.with_folds(frame(spark)).filter("held_out")
    rows = T.score(held, T.fit(held)).collect()
    assert rows and all(abs(r.score + r.bits_per_byte * 0 - math.log10(0.5) * 8 * round(r.score / math.log10(0.5) / 8)) < 1e-9 for r in rows)
    assert all(r.base_score == 0 and r.n_known == 0 and abs(r.bits_per_byte - 8) < 1e-9 for r in rows)


def test_log_gamma():
    x = np.array([0.5, 1.0, 2.5, 7.99, 8.0, 1e3, 1e9])
    assert np.allclose(T._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_run_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    table = T.RunTable(keys, np.arange(len(keys), dtype=float))
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert np.isnan(table.find(keys + np.uint64(1 << 41))).all()
    assert np.isnan(T.RunTable(keys[:0], np.zeros(0)).find(keys)).all()
