"""The additive model: learning, tables, and awkward input."""

import random

import numpy as np

from sparsight.llm import quality_model as Q


def corpus(spark, n=600):
    rng = random.Random(4)
    words = ["river", "bridge", "walks", "under", "a", "the", "quiet", "town", "of", "glass"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        text = " ".join(rng.choices(words, k=80)).capitalize() + "."
        rows.append((i, text if good else rng.choice([text.upper() + "!!", text.replace(" ", " ## "), "same " * 80])))
        if rng.random() < 0.8:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = Q.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(spark, 200)
    held = "crc32(cast(doc_id as string)) % 4 = 2"
    turned = labels.selectExpr("doc_id", f"CASE WHEN {held} THEN 1 - quality ELSE quality END AS quality")
    score = lambda x: sorted(map(tuple, Q.score_documents(docs, x).collect()))
    assert score(labels) == score(turned)


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(Q.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = Q.fit_model(x, y)
    assert (model.pairs[0][0], model.pairs[0][1]) == (3, 7)
    fresh = rng.random((2000, len(Q.FEATURES)))
    assert ((model.score(fresh) > 0.5) == ((fresh[:, 3] > 0.5) ^ (fresh[:, 7] > 0.5))).mean() > 0.95


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(1)
    x = rng.random((300, len(Q.FEATURES)))
    model = Q.fit_model(x, (x[:, 0] > 0.4).astype(float))
    for row in x[:20]:
        at = [int((e <= v).sum()) for e, v in zip(model.edges, row)]
        total = model.start + sum(t[i] for t, i in zip(model.tables, at))
        total += sum(t[model.coarse[a][at[a]], model.coarse[b][at[b]]] for a, b, t in model.pairs)
        assert abs(1 / (1 + np.exp(-total)) - model.score(row[None])[0]) < 1e-12


def test_awkward_rows(spark, awkward_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 0, 1), (4, 1, 0), (4, 0, 0), (7, 1, None), (8, None, 0), (6, 5, 0), (None, 1, 1), (18, 1, 0), (9, 1, 0)],
        "doc_id bigint, quality int, features int",
    )
    rows = Q.score_documents(awkward_docs, labels).collect()
    assert len(rows) == awkward_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in Q.score_documents(awkward_docs, labels.limit(0)).collect()} == {0.5}
    assert Q.score_documents(no_docs, labels).count() == 0
    one_class = labels.filter("quality = 1")
    assert all(0 <= r.score <= 1 for r in Q.score_documents(awkward_docs, one_class).collect())


def test_bounded_sample(spark):
    docs, labels = corpus(spark, 400)
    measured = Q.measure(docs)
    x, y = Q.sample_of(measured, labels, rows=100)
    assert 60 <= len(x) <= 140 and len(x) == len(y)


def test_a_repeated_labelled_row_is_sampled_once(spark):
    row = lambda i, v: (i, [float(v)] * len(Q.FEATURES))
    ids = [i for i in range(400) if i % 7]
    measured = spark.createDataFrame([row(i, i) for i in ids] + [row(1, 1)] * 300, "doc_id bigint, features array<double>")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    x, y = Q.sample_of(measured, labels)
    assert len(x) == len({tuple(r) for r in x.tolist()}) == len(y) > 200
    other = spark.createDataFrame([row(1, v) for v in range(2000)], "doc_id bigint, features array<double>")
    x, y = Q.sample_of(measured.unionByName(other), labels.filter("doc_id < 40"), rows=100)
    assert 60 <= len(x) <= 140 and len(x) == len(y)
