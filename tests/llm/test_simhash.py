"""Fingerprints, cells and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sparsight.llm import components
from sparsight.llm import simhash as S
from sparsight.llm.components import connected


def brute_print(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    root = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("tile", [4096, 4])
def test_components_equal_brute_force(spark, monkeypatch, awkward, awkward_docs, tile):
    monkeypatch.setattr(S, "TILE_ROWS", tile)
    got = S.components(awkward_docs, 3, 1, 3).collect()
    prints = [brute_print(t) for _, t in awkward]
    root = brute_components(prints)
    smallest = {}
    for (i, _), r in zip(awkward, root):
        if i is not None:
            smallest[r] = min(smallest.get(r, i), i)
    expected = sorted((str(i), p, str(smallest.get(r))) for (i, _), p, r in zip(awkward, prints, root))
    assert sorted((str(r.doc_id), int.from_bytes(r.fp, "little"), str(r.component_id)) for r in got) == expected


@pytest.mark.parametrize(("agree", "rows"), [(1, 100), (2, 1 << 23), (3, 1 << 32)])
def test_cells_hold_every_pair_within_the_radius(agree, rows):
    masks = S.cell_masks(1, 3, rows)
    rng = np.random.default_rng(agree)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for _, m in masks)


def test_large_and_small_cells_agree(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    flips = np.array([(1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 40, (300, 2))], dtype=np.uint64)
    fps = (base[rng.integers(0, 12, 300)] ^ flips)[:, None]
    group = np.sort(rng.integers(0, 3, 300))
    refs = S.references(1)
    large = S.cell_roots(group, fps, 3, refs)
    monkeypatch.setattr(S, "SMALL_CELL", 1000)
    assert (S.cell_roots(group, fps, 3, refs) == large).all()
    for g in range(3):
        at = np.flatnonzero(group == g)
        root = brute_components([int(x) for x in fps[at, 0]])
        assert [int(r) for r in large[at] - at[0]] == root


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_ROWS", 64)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(200):
        some = list(words)
        some[i % 400] = f"changed{i}"
        rows.append((i, " ".join(some)))
    rows += [(1000 + i, " ".join(f"other{i}x{k}" for k in range(200))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in S.drop_near_duplicates(docs).collect())
    assert kept == [0, *range(1000, 1050)]


def test_fingerprints_alone_find_close_copies(spark, monkeypatch):
    # Without the bands of MinHash values, near copies are those that the cells with pivots link.
    monkeypatch.setattr(S, "band_links", lambda nodes: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), raising=False)
    rows = []
    for i in range(20):
        words = [f"t{i}w{k}" for k in range(1500)]
        other = list(words)
        other[700] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    rows += [(100, "a b a b a b a b a b"), (101, "a b a b a b")]  # one set, two fingerprints
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(range(0, 40, 2)) <= kept and 100 in kept and 101 not in kept
    assert sum(i % 2 for i in kept) <= 4


def test_near_copies_by_similarity(spark):
    rng = np.random.default_rng(5)
    rows, jaccard = [], []
    for i in range(120):
        words = [f"a{x}" for x in rng.integers(0, 100_000, 300)]
        other = list(words)
        for at in rng.choice(300, 3, replace=False):
            other[at] = f"b{at}"
        sets = [{tuple(w[k : k + 5]) for k in range(296)} for w in (words, other)]
        jaccard.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert min(jaccard) >= 0.9
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i for i in kept if i % 2 == 0} == set(range(0, 240, 2))
    assert sum(i % 2 for i in kept) <= 3  # recall of at least 97 %


def shingles_of(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("tile", [4096, 2])
def test_near_copies_are_exactly_those_of_a_jaccard_of_0_8(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE_ROWS", tile)
    rng = np.random.default_rng(11)
    rows, near = [], {}
    for i in range(400):
        size = int(rng.choice([5, 8, 9, 20, 60, 300]))
        words = [f"a{i}x{x}" for x in rng.integers(0, 100_000, size)]
        cut = max(1, int(size * rng.uniform(0.02, 0.24)))
        other = [f"b{x}" for x in rng.integers(0, 100_000, cut)] + words[cut // 2 :] if i % 2 else words[cut:]
        sets = [shingles_of(" ".join(w)) for w in (words, other)]
        near[2 * i + 1] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    some = [j for j in near.values() if 0.75 <= j < 0.95]
    assert len(some) > 100 and min(some) < 0.8 < 0.82 < max(some)
    rows += [(5000 + i, rows[3][1]) for i in range(5)]  # exact copies
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {*range(0, 800, 2), *(i for i, j in near.items() if j < 0.8)}


def test_a_group_in_tiles_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_ROWS", 7)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        some = list(words)
        for at in rng.integers(0, 80, int(rng.integers(0, 5))):
            some[at] = f"c{i}x{at}"
        rows.append((i, " ".join(some)))
    sets = [shingles_of(t) for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == set(root) and len(kept) > 1


def test_dropping_keeps_one_row(awkward_docs, no_docs):
    kept = S.drop_near_duplicates(awkward_docs)
    assert kept.columns == awkward_docs.columns
    rows = kept.collect()
    ids = sorted(str(r.doc_id) for r in rows)
    assert ids.count("7") == 1 and "8" not in ids and "9" not in ids and "1" in ids and "2" not in ids
    # One id may stand for different texts; those are different groups, and each keeps one row.
    assert sorted(r.text for r in rows if r.doc_id == 18) == ["not the same", "repeat"]
    assert S.drop_near_duplicates(no_docs).count() == 0
    assert S.components(no_docs, 3, 1, 3).count() == 0


def test_null_and_repeated_ids_bring_no_rows_together(spark):
    def story(i):
        return " ".join(f"s{i}w{k}" for k in range(40 + i % 3))

    rows = [(None, story(i)) for i in range(30)] + [(1, story(0)), (2, story(1)), (2, story(1)), (3, story(2) + " more")]
    rows += [(7, story(100 + i)) for i in range(5)] + [(7, story(100))] * 3 + [(None, story(50))] * 4 + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r.doc_id, r.text or "") for r in S.drop_near_duplicates(docs).collect()]
    expected = [(None, story(i)) for i in range(3, 30)] + [(1, story(0)), (2, story(1)), (3, story(2) + " more")]
    expected += [(7, story(100 + i)) for i in range(5)] + [(None, story(50)), (None, "")]
    assert sorted(kept, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("plain", [components.PLAIN_LINKS, 0])
def test_connected(spark, monkeypatch, plain):
    monkeypatch.setattr(components, "PLAIN_LINKS", plain)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 201: 200, 202: 200}
