"""The automaton against windows found by brute force."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sparsight.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    own = words(text)
    hit, found = set(), set()
    for item, body in items:
        w = words(body)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(own) - size + 1):
                if own[i : i + size] == w[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def cases(seed):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choices(some, k=rng.choice([1, 2, 3, 5, 13, 14, 20, 40])))) for i in range(14)]
    items += [(90, None), (91, ""), (92, "!!"), (5, items[5][1]), (None, "w1 w1 w1 w1 no id")]
    docs = []
    for i in range(60):
        parts = rng.choices([*some, "other", "W0", "w0.w1", "x"], k=rng.choice([0, 3, 20, 60]))
        if rng.random() < 0.6:
            own = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(own) + 1)
            parts[len(parts) // 2 : 0] = own[at : at + rng.randrange(30)]
        docs.append((i, " ".join(parts)))
    return docs + [(60, None), (61, docs[3][1]), (61, docs[3][1]), (None, docs[4][1])], items


def test_automaton_equals_brute_force():
    for seed in range(30):
        docs, items = cases(seed)
        items = [x for x in items if x[0] is not None]
        automaton = D.SuffixAutomaton([(str(i), (t or "").encode()) for i, t in items if t])
        for _, text in docs:
            n, spans, found = automaton.scan((text or "").encode())
            assert (n, sum(b - a for a, b in spans), sorted(found)) == brute(text, items), (seed, text)
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_one_block_and_many(spark):
    docs, items = cases(99)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id bigint, text string, doc_id string")
    listed = [x for x in items if x[0] is not None]
    expected = Counter((i, n, tuple(f)) for i, (n, _, f) in ((i, brute(t, listed)) for i, t in docs))
    for block_bytes in (1 << 20, 100):
        rows = D.find_spans(frame, bench, block_bytes=block_bytes).withColumn("n_hit", D.n_hit()).collect()
        assert Counter((r.doc_id, r.n_words, tuple(r["items"])) for r in rows) == expected
        hits = Counter((r.doc_id, r.n_hit) for r in rows)
        assert hits == Counter((i, brute(t, items)[1]) for i, t in docs)


def test_removal(spark, awkward_docs, no_docs):
    item = " ".join(f"q{i}" for i in range(20))
    far = " ".join(f"f{i}" for i in range(600))
    rows = [(1, f"{far}, {item.upper()}! {far}"), (2, f"start {item} end"), (3, far), (4, None)]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = {r.doc_id: r.text for r in D.decontaminate(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert kept == {1: f"{far}, ! {far}", 3: far, 4: None}
    assert D.decontaminate(awkward_docs, bench).columns == awkward_docs.columns
    assert D.decontaminate(awkward_docs, bench).count() == awkward_docs.count()
    assert D.decontaminate(awkward_docs, bench.limit(0)).count() == awkward_docs.count()
    assert D.decontaminate(no_docs, bench).count() == 0
    assert D.find_spans(no_docs, bench).count() == 0


def test_coverage_limit(spark):
    rows = spark.createDataFrame([(0, 0), (1, 20), (1, 21), (13, 260), (13, 261)], "n_hit bigint, n_words bigint")
    assert [r[0] for r in rows.select(D.contaminated()).collect()] == [False, True, False, True, False]
    assert F is not None
