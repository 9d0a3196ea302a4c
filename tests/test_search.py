import os

import numpy as np
import pyarrow as pa
import pytest

from sparsight.operators import blocks, dense, sparse, sparse_blocks, sparse_index


def vector_frame(spark, key, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{key} long, vec array<double>")


def hits_of(df, *keys):
    return sorted(tuple(r[k] for k in ("qid", "rank", "pid", "score")) for r in df.collect())


def left_fold(x, y):
    total = 0.0
    for a, b in zip(x, y):
        total += a * b
    return total


def brute_dense(q, p, k):
    out = []
    for i, x in enumerate(q):
        scores = [left_fold(x, y) for y in p]
        best = sorted(range(len(p)), key=lambda j: (-scores[j], j))[:k]
        out += [(i, n + 1, j, scores[j]) for n, j in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("grid", [(1, 1), (3, 2), (2, 5)])
def test_dense_equals_brute_force_on_any_grid(spark, grid):
    rng = np.random.default_rng(1)
    q, p = rng.random((9, 8)), rng.random((23, 8))
    hits = dense.dense_topk_sharded(vector_frame(spark, "qid", q), vector_frame(spark, "pid", p), 4, *grid)
    assert hits_of(hits) == brute_dense(q.tolist(), p.tolist(), 4)


def test_hits_as_arrays_are_the_best_products(spark):
    rng = np.random.default_rng(2)
    q, p = rng.normal(size=(7, 24)), rng.normal(size=(31, 24))
    hits = dense.dense_topk(vector_frame(spark, "qid", q), vector_frame(spark, "pid", p), 4)
    rows = dense.hits_as_arrays(hits).orderBy("qid").collect()
    products = q @ p.T
    best = np.argsort(-products, axis=1)[:, :4]
    assert [r.pids for r in rows] == best.tolist()
    np.testing.assert_allclose([r.scores for r in rows], np.take_along_axis(products, best, axis=1), rtol=1e-12)


def test_dense_ties_go_to_the_smaller_id_even_past_k(spark):
    p = vector_frame(spark, "pid", [[1.0, 0.0]] * 40)
    q = vector_frame(spark, "qid", [[1.0, 1.0]])
    hits = dense.dense_topk_sharded(q, p, 3, 1, 4)
    assert [h[2] for h in hits_of(hits)] == [0, 1, 2]


def test_dense_k_larger_than_the_table(spark):
    p, q = vector_frame(spark, "pid", [[1.0], [2.0]]), vector_frame(spark, "qid", [[1.0]])
    assert [h[2] for h in hits_of(dense.dense_topk(q, p, 10))] == [1, 0]


def test_dense_add_continues_row_numbers(spark):
    a = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0])], "row_idx long, pid string, vec array<double>")
    b = spark.createDataFrame([(0, "c", [3.0])], a.schema)
    assert [(r.row_idx, r.pid) for r in dense.dense_add(a, b).orderBy("row_idx").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert dense.dense_add(a.limit(0), b).first().row_idx == 0


def test_sparse_golden(spark):
    # Documents, ids and scores that a sparse index must give.
    index = spark.createDataFrame(
        [("1", {"a": 1.0, "b": 2.0}), ("2", {"a": 2.0, "b": 3.0})], "pid string, features map<string,double>"
    )
    postings = sparse.from_feature_map(index, "pid")
    asked = postings.withColumnRenamed("pid", "qid")
    rows = dense.hits_as_arrays(sparse.sparse_topk(asked, postings, 2)).orderBy("qid").collect()
    assert [r.pids for r in rows] == [["2", "1"], ["2", "1"]]
    assert [r.scores for r in rows] == [[8.0, 5.0], [13.0, 8.0]]


def random_postings(rng, key, ids, features, hot):
    rows = []
    for i in range(ids):
        chosen = set(rng.choice(features, size=rng.integers(1, 6), replace=False).tolist())
        if rng.random() < hot:
            chosen.add(0)
        rows += [(i, int(f), float(rng.normal())) for f in chosen]
    return rows


def brute_sparse(q, d, k):
    docs = {}
    for i, f, w in d:
        docs.setdefault(f, []).append((i, w))
    scores = {}
    for i, f, w in sorted(q):
        for j, v in docs.get(f, []):
            scores[i, j] = scores.get((i, j), 0.0) + w * v
    out = []
    for i in {i for i, _, _ in q}:
        best = sorted(((-s, j) for (a, j), s in scores.items() if a == i))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("grid", [(1, 1), (3, 4)])
@pytest.mark.parametrize("scratch", [4_000_000, 64])
@pytest.mark.parametrize("features", [12, 400])
def test_sparse_equals_brute_force(spark, monkeypatch, grid, scratch, features):
    monkeypatch.setattr(sparse, "SCRATCH", scratch)
    rng = np.random.default_rng(features)
    q, d = random_postings(rng, "qid", 20, features, 0.4), random_postings(rng, "pid", 60, features, 0.4)
    asked = spark.createDataFrame(q, "qid long, feature int, weight double")
    index = spark.createDataFrame(d, "pid long, feature int, weight double")
    assert hits_of(sparse.sparse_topk(asked, index, 3, *grid)) == brute_sparse(q, d, 3)


@pytest.mark.parametrize("limit", [3, 4, 5])
def test_heavy_ids_are_scored_by_a_join(spark, monkeypatch, limit):
    monkeypatch.setattr(sparse, "HEAVY_POSTINGS", limit)
    rng = np.random.default_rng(limit)
    q, d = random_postings(rng, "qid", 20, 12, 0.4), random_postings(rng, "pid", 60, 12, 0.4)
    heavy = {i for i, _, _ in d if sum(j == i for j, _, _ in d) > limit}
    assert 0 < len(heavy) < 60
    asked = spark.createDataFrame(q, "qid long, feature int, weight double")
    index = spark.createDataFrame(d, "pid long, feature int, weight double")
    got = hits_of(sparse.sparse_topk(asked, index, 5))
    wanted = brute_sparse(q, d, 5)
    assert [h[:3] for h in got] == [h[:3] for h in wanted]
    np.testing.assert_allclose([h[3] for h in got], [h[3] for h in wanted])


def patch_sizes(monkeypatch, **sizes):
    """Sets bounds wherever they are used."""
    for module in (sparse, sparse_blocks, sparse_index):
        for name, value in sizes.items():
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)


@pytest.mark.parametrize(
    ("heavy", "send", "grid"),
    [(2, 300, (None, None)), (3, 64 << 20, (None, None)), (1000, 300, (None, None)), (2, 300, (2, 3)), (1000, 64 << 20, (2, 3))],
)
def test_all_ways_give_the_same_bits(spark, monkeypatch, heavy, send, grid):
    # Small blocks with several runs, wide documents in slices, wide queries, queries in parts.
    patch_sizes(monkeypatch, HEAVY_POSTINGS=heavy, BLOCK_POSTINGS=16, BLOCK_DOCS=7, RUN_POSTINGS=1, RUN_DOCS=1, SEND_BYTES=send, MOST_PARTS=99)
    rng = np.random.default_rng(heavy)
    q, d = random_postings(rng, "qid", 20, 12, 0.4), random_postings(rng, "pid", 60, 12, 0.4)
    q += [(30, f, float(rng.normal())) for f in range(12)]
    d += [(90, f, float(rng.normal())) for f in range(40)] + [(91, 0, 1e300), (92, 0, -1e-300)]
    asked = spark.createDataFrame(q, "qid long, feature int, weight double").repartition(3)
    index = spark.createDataFrame(d, "pid long, feature int, weight double").repartition(5)
    assert hits_of(sparse.sparse_topk(asked, index, 5, *grid)) == brute_sparse(q, d, 5)


@pytest.mark.parametrize("heavy", [2, 1000])
@pytest.mark.parametrize("positive", [False, True])
def test_many_queries_meet_packed_blocks(spark, monkeypatch, base, heavy, positive):
    patch_sizes(monkeypatch, HEAVY_POSTINGS=heavy, BLOCK_POSTINGS=40, BLOCK_DOCS=20, RUN_POSTINGS=1, RUN_DOCS=1, SEND_BYTES=100)
    patch_sizes(monkeypatch, GROUP_BYTES=1500, PACK_ROWS=10, SPLIT_BYTES=900)
    rng = np.random.default_rng(heavy)
    q, d = random_postings(rng, "qid", 40, 12, 0.4), random_postings(rng, "pid", 150, 12, 0.4)
    if positive:
        q, d = ([(i, f, abs(w)) for i, f, w in x] for x in (q, d))
    q += [(100 + i, 3, 1.0) for i in range(5)] + [(200, f, 2.0) for f in range(12)] + [(300, 999, 1.0)]
    asked = spark.createDataFrame(q, "qid long, feature int, weight double").repartition(3)
    index = spark.createDataFrame(d, "pid long, feature int, weight double").repartition(5)

    def refuse(*_):
        raise AssertionError("queries pass through the driver")

    monkeypatch.setattr(sparse_index, "search_blocks", refuse)
    assert hits_of(sparse.sparse_topk(asked, index, 5)) == brute_sparse(q, d, 5)
    sparse.sparse_index_create(spark, base, "m", index)
    again = [(i, f, 3.0 if positive else w - 1) for i, f, w in d if i % 7 == 0]
    sparse.sparse_index_add(spark, base, "m", spark.createDataFrame(again, "pid long, feature int, weight double"), merge=False)
    now = [x for x in d if x[0] % 7] + again
    assert hits_of(sparse.sparse_index_search(spark, base, "m", asked, 5)) == brute_sparse(q, now, 5)


def test_best_hits_put_nan_last():
    rows = np.repeat([0, 1], 6)
    cols = np.tile(np.arange(6), 2)
    scores = np.array([np.nan, 3.0, np.nan, 1.0, np.nan, 2.0, np.nan, np.nan, np.nan, np.nan, np.nan, 5.0])
    found = sparse_blocks.best_hits(rows, cols, scores, 2, 3)
    assert found[0].tolist() == [0, 0, 0, 1, 1, 1] and found[1].tolist() == [1, 5, 3, 5, 0, 1]


@pytest.mark.parametrize("repeats", [False, True])
def test_dense_products_have_the_same_bits(repeats):
    rng = np.random.default_rng(3)
    q = [(i, f, float(rng.exponential())) for i in range(30) for f in rng.choice(24, 6, replace=False).tolist()]
    d = [(i, f, float(rng.exponential())) for i in range(400) for f in rng.choice(24, 5, replace=False).tolist()]
    d += [(500 + i, 0, 1.0) for i in range(20)]  # ties
    if repeats:
        d.insert(1, d[0])
    tables = [pa.table({c: pa.array([r[i] for r in rows]) for i, c in enumerate((name, "feature", "weight"))}) for rows, name in ((q, "qid"), (d, "pid"))]
    search = sparse_blocks.Search(sparse_blocks.Queries.of(tables[0]), 7)
    made = []
    dense = search._dense
    search._dense = lambda *a: made.append(dense(*a)) or made[-1]
    for start in range(0, len(d), 500):
        block = sparse_blocks.built_block(tables[1].slice(start, 500))
        body = sparse_blocks.packed_block(block)
        for a, b in zip(vars(block).values(), vars(sparse_blocks.unpacked_block(body)).values()):
            assert a is b is None or (np.asarray(a) == np.asarray(b)).all()
        search.add(block)
    got = sorted((r["qid"], r["pid"], r["score"]) for b in search.hits(pa.int64(), pa.int64()) for r in b.to_pylist())
    assert got == sorted((i, j, s) for i, _, j, s in brute_sparse(q, d, 7))
    assert any(x is None for x in made) == repeats and not all(x is None for x in made)


def test_bounds_skip_postings_and_lose_nothing(spark, monkeypatch, base):
    patch_sizes(monkeypatch, BLOCK_POSTINGS=3000, RUN_POSTINGS=4, RUN_DOCS=8)
    rng = np.random.default_rng(2)
    d = [(i, int(f), float(rng.exponential() + 4 * (f == i % 30))) for i in range(2000) for f in {i % 30, *rng.integers(0, 30, 4).tolist()}]
    q = [(i, int(f), float(rng.exponential())) for i in range(25) for f in {i, *rng.integers(0, 30, 3).tolist()}]
    asked = spark.createDataFrame(q, "qid long, feature int, weight double")
    sparse.sparse_index_create(spark, base, "m", spark.createDataFrame(d, "pid long, feature int, weight double"))
    assert hits_of(sparse.sparse_index_search(spark, base, "m", asked, 4)) == brute_sparse(q, d, 4)
    assert sparse_index.skipped_share(spark, base, "m", asked, 4) > 0.4
    plan = sparse.sparse_index_search(spark, base, "m", asked, 4)._jdf.queryExecution().executedPlan().toString()
    # Blocks stay: what moves are hits on their way to the final ranks.
    assert plan.count("Exchange") == 1 and "hashpartitioning(qid" in plan


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_segments(spark, base):
    rng = np.random.default_rng(8)
    schema = "pid long, feature int, weight double"

    def some(pids):
        return [(int(p), int(f), float(rng.normal())) for p in pids for f in rng.choice(200, 6, replace=False)]

    q = [(i, int(f), float(rng.normal())) for i in range(15) for f in rng.choice(200, 9, replace=False)]
    asked = spark.createDataFrame(q, "qid long, feature int, weight double")
    live = {}

    def matches():
        rows = [r for held in live.values() for r in held]
        assert hits_of(sparse.sparse_index_search(spark, base, "m", asked, 5)) == brute_sparse(q, rows, 5)
        assert sorted(map(tuple, sparse.sparse_index_open(spark, base, "m").collect())) == sorted(rows)

    def put(rows, **options):
        for p in {r[0] for r in rows}:
            live[p] = [r for r in rows if r[0] == p]
        sparse.sparse_index_add(spark, base, "m", spark.createDataFrame(rows, schema), **options)

    put(some(range(8_000)))
    before = folder_bytes(base)
    for turn in range(3):
        put(some([turn, 50, 51, 30_000 + turn]))
    grown = folder_bytes(base) - before
    # What an addition writes follows the batch: as much for an index of a twentieth of the size.
    small = spark.createDataFrame(some(range(400)), schema)
    sparse.sparse_index_create(spark, f"{base}/other", "m", small)
    before = folder_bytes(f"{base}/other")
    for turn in range(3):
        sparse.sparse_index_add(spark, f"{base}/other", "m", spark.createDataFrame(some([turn, 50, 51, 30_000 + turn]), schema), merge=False)
    assert grown < 1.5 * (folder_bytes(f"{base}/other") - before)
    matches()
    old = sparse_index.newest_version(spark, base, "m")
    put(some([7, 30_001]))  # the fourth small segment: the small ones are merged
    newest = sparse_index.newest_version(spark, base, "m")
    assert len(old.segments) == 4 and len(newest.segments) == 2 and max(s.postings for s in newest.segments) == 48_000
    matches()
    put(some([7, 9]))
    sparse.sparse_index_compact(spark, base, "m", everything=True)
    newest = sparse_index.newest_version(spark, base, "m")
    assert len(newest.segments) == 1 and newest.deletes == [] and newest.segments[0].documents == len(live)
    matches()


def test_wide_documents_are_replaced(spark, base, monkeypatch):
    patch_sizes(monkeypatch, HEAVY_POSTINGS=10, BLOCK_POSTINGS=8)
    schema = "pid long, feature int, weight double"
    wide = [(1, f, 1.0) for f in range(40)] + [(2, f, 2.0) for f in range(3)]
    sparse.sparse_index_create(spark, base, "m", spark.createDataFrame(wide, schema))
    assert sparse.sparse_index_statistics(spark, base, "m") == (43, 40)
    asked = spark.createDataFrame([(5, f, 1.0) for f in range(40)], "qid long, feature int, weight double")
    assert hits_of(sparse.sparse_index_search(spark, base, "m", asked, 3)) == [(5, 1, 1, 40.0), (5, 2, 2, 6.0)]
    sparse.sparse_index_add(spark, base, "m", spark.createDataFrame([(1, 0, 7.0)], schema))
    assert hits_of(sparse.sparse_index_search(spark, base, "m", asked, 3)) == [(5, 1, 1, 7.0), (5, 2, 2, 6.0)]


def test_sparse_query_without_shared_feature_has_no_rows(spark):
    index = spark.createDataFrame([(1, 7, 1.0)], "pid long, feature int, weight double")
    asked = spark.createDataFrame([(5, 8, 1.0), (6, 7, -2.0)], "qid long, feature int, weight double")
    assert hits_of(sparse.sparse_topk(asked, index, 3)) == [(6, 1, 1, -2.0)]


def test_sparse_batch_keeps_query_order(spark):
    index = spark.createDataFrame([(1, 7, 1.0), (2, 7, 2.0)], "pid long, feature int, weight double")
    asked = spark.createDataFrame([(5, 7, 1.0), (6, 7, 1.0)], "qid long, feature int, weight double")
    places = spark.createDataFrame([(5, 1), (6, 0)], "qid long, row_idx long")
    rows = sparse.sparse_topk_batch(asked, places, index, 2).collect()
    assert [(r.qid, r.pid) for r in rows] == [(6, 2), (6, 1), (5, 2), (5, 1)]


def test_upsert_replaces_whole_documents(spark):
    schema = "pid string, feature string, weight double"
    old = spark.createDataFrame([("1", "a", 1.0), ("1", "b", 2.0), ("2", "a", 3.0)], schema)
    new = spark.createDataFrame([("1", "c", 9.0), ("3", "a", 4.0)], schema)
    rows = sorted(map(tuple, sparse.sparse_index_upsert(old, new).collect()))
    assert rows == [("1", "c", 9.0), ("2", "a", 3.0), ("3", "a", 4.0)]


def test_index_wipe_and_keep(spark, base):
    schema = "pid string, feature string, weight double"
    one, two = (spark.createDataFrame([(p, "a", 1.0)], schema) for p in "12")
    assert sparse.sparse_index_open(spark, base, "m") is None
    sparse.sparse_index_create(spark, base, "m", one)
    sparse.sparse_index_create(spark, base, "m", two, wipe=False)
    assert [r.pid for r in sparse.sparse_index_open(spark, base, "m").collect()] == ["1"]
    sparse.sparse_index_create(spark, base, "m", two)
    assert [r.pid for r in sparse.sparse_index_open(spark, base, "m").collect()] == ["2"]


def test_exact_dots_are_left_folds():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(4, 33)), rng.normal(size=(6, 33))
    rows, cols = np.array([0, 3, 2]), np.array([5, 1, 0])
    for got, i, j in zip(blocks.exact_dots(x, y, rows, cols), rows, cols):
        assert got == left_fold(x[i].tolist(), y[j].tolist())


def test_fetch_vectors_and_feature_maps(spark):
    hits = spark.createDataFrame([(1, 10, 1)], "qid long, pid long, rank int")
    stored = spark.createDataFrame([(10, [1.0, 2.0]), (11, [3.0, 4.0])], "pid long, vec array<double>")
    assert sparse.fetch_vectors(hits, stored).first().vec == [1.0, 2.0]
    postings = spark.createDataFrame([(1, 5, 2.0), (1, 6, -1.0)], "pid long, feature int, weight double")
    assert sparse.to_feature_map(postings, "pid").first().features == {5: 2.0, 6: -1.0}
    assert sparse.positive_only(postings).count() == 1


@pytest.mark.parametrize("kind", ["normal", "ties", "copies", "tiny", "huge", "mixed"])
@pytest.mark.parametrize("biased", [False, True])
def test_single_precision_chooses_what_double_precision_finds(monkeypatch, kind, biased):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(37, 12)), rng.normal(size=(300, 12))
    if kind == "ties":
        x, y = np.round(x), np.round(y)
    elif kind == "copies":
        y = np.tile(y[:60], (5, 1)) * (1 + 1e-12 * rng.integers(0, 3, (300, 1)))
    elif kind == "tiny":
        x, y = x * 1e-30, y * 1e-12
    elif kind == "huge":
        x, y = x * 1e30, y * 1e30
    elif kind == "mixed":
        y[::7], y[3], x[5] = y[::7] * 1e9, np.nan, np.inf
    bias = rng.normal(size=300) * np.abs(y[np.isfinite(y)]).max() if biased else None
    want = blocks.top_products(x, y, bias, 6)
    monkeypatch.setattr(blocks, "TILE_COLS", 32)
    monkeypatch.setattr(blocks, "TILE_ROWS", 10)
    got = blocks.top_products(x, y, bias, 6)
    assert all(np.array_equal(a, b) for a, b in zip(want, got))
    edge = np.full(37, -np.inf)
    edge[want[0][want[3] == 6]] = want[2][want[3] == 6]
    again = blocks.top_products(x, y, bias, 6, edge)
    assert all(np.array_equal(a, b) for a, b in zip(want, again))
    edge[want[0][want[3] == 2]] = want[2][want[3] == 2]
    above = want[2] >= edge[want[0]]
    few = blocks.top_products(x, y, bias, 6, edge)
    assert all(np.array_equal(a[above], b) for a, b in zip(want, few))


def test_groups_read_the_right_side_where_it_is(spark, monkeypatch):
    rng = np.random.default_rng(6)
    q, p = np.round(rng.normal(size=(90, 8)), 1), np.round(rng.normal(size=(130, 8)), 1)
    left, right = vector_frame(spark, "qid", q), vector_frame(spark, "pid", p).repartition(3)
    want = brute_dense(q.tolist(), p.tolist(), 7)
    for name, value in {"SEND_BYTES": 0, "BLOCK_BYTES": 1500, "WAVE": 5}.items():
        monkeypatch.setattr(blocks, name, value)
    hits = dense.dense_topk(left, right, 7)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CoGroup" not in plan
    assert hits.rdd.getNumPartitions() > 8
    assert hits_of(hits) == want
    # Equal keys share their hits, null ones, too, as in a search whose left side is sent.
    odd = left.selectExpr("nullif(qid % 40, 3) AS qid", "vec")
    shared = dense.dense_topk(odd, right, 7)
    monkeypatch.undo()
    order = lambda df: sorted((-1 if r.qid is None else r.qid, r.rank, r.score) for r in df.collect())
    assert order(shared) == order(dense.dense_topk(odd, right, 7))


def test_pairs_search_their_neighbours_once(spark, monkeypatch, tmp_path):
    from sparsight.operators import pairs, skew

    counted = spark.sparkContext.accumulator(0)
    near = spark.createDataFrame([(q, r, (q + r) % 9) for q in range(30) for r in (1, 2)], "qid long, rank int, pid long")

    def count(stream):
        for batch in stream:
            counted.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(skew, "is_sent", lambda frame: False)
    vectors = vector_frame(spark, "pid", np.eye(9))
    built = pairs.build_pairs(near.mapInArrow(count, near.schema), vector_frame(spark, "qid", np.ones((30, 9))), vectors, 2)
    assert built.count() == 30 and counted.value == 60


def test_groups_of_queries_read_blocks_without_copying_them(spark, monkeypatch, base):
    import pyarrow.parquet as pq

    patch_sizes(monkeypatch, BLOCK_POSTINGS=40, BLOCK_DOCS=20, RUN_POSTINGS=1, RUN_DOCS=1, GROUP_BYTES=1500)
    rng = np.random.default_rng(8)
    q, d = random_postings(rng, "qid", 40, 12, 0.4), random_postings(rng, "pid", 150, 12, 0.4)
    asked = spark.createDataFrame(q, "qid long, feature int, weight double")
    index = spark.createDataFrame(d, "pid long, feature int, weight double").coalesce(1)
    sparse.sparse_index_create(spark, base, "m", index)
    newest = sparse_index.newest_version(spark, base, "m")
    blocks_now = sparse_index._live_blocks(spark, newest)
    hits = sparse_blocks.search_in_cells(blocks_now, asked, 5, sparse_index.query_sizes(asked))
    assert hits.rdd.getNumPartitions() > 4
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    # A block is a row of many megabytes: Spark reads one at a time.
    folder = newest.segments[0].folder.removeprefix("file:")
    files = [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")]
    groups = [pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(groups) == blocks_now.count() > len(files) and max(groups) == 1
