"""Near-duplicates: SimHash, found with tables of distances to reference fingerprints; and exact Jaccard.

A fingerprint has one or more 64-bit words; a bit is 1 if it is set in more than half of the hashes
of a text's word shingles (repeats included).  Equal fingerprints are one node from the start.

Different fingerprints meet in cells: rows that agree in some blocks of bits.  For one word and a
radius r, blocks are chosen so that any two fingerprints within r agree in all blocks of some cell
(pigeonhole).  For more words, every 16-bit block is a cell, and near copies share one with a
probability that rises with their similarity; ``drop_near_duplicates`` does not rely on these.  In a cell each row has its table of distances to many
fixed reference fingerprints.  By the triangle inequality two rows can be within r only if no
coordinate differs by more than r; pairs that pass are verified by their exact distance.  A cell
emits a spanning forest of its links, at most one row per member, never its pairs.  Cells of more
than ``TILE_ROWS`` rows are cut into tiles that cover all their pairs.  The forests are joined into
components by grouped minima.

Whole documents are near copies if the sets of their shingles have a Jaccard similarity of at least
``SIMILARITY``.  Texts whose fingerprints (those of op1) are linked in cells with pivots are candidates, and
so are, for the similarities that 64 bits miss, sets that agree in some band of MinHash values; the components of both are
verified by the exact similarity of every pair.  A component beyond a tile's bounds is cut into tiles
that cover all its pairs.

Defined results: a null text or one without words has fingerprint zero and is linked like any other;
repeated rows share a component; a null doc_id is never a component's id unless it has no other;
an empty table gives no rows; further columns are ignored or carried along.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.llm.components import connected
from sparsight.storage import materialize

HASH_SEED = 42
REFERENCES = 16
TILE_ROWS = 4096
#: Cells up to this size are compared by shifts over many cells at once.
SMALL_CELL = 32
#: Of fingerprints of documents: shingle words, words of 64 bits, and the bits by which linked ones differ at most.
PRINT_SHINGLE, PRINT_WORDS, RADIUS = 3, 1, 3
#: Of near copies of whole documents: shingle words, similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands and MinHash values of each: at a similarity of 0.8 all bands miss with a probability of 0.00006.
BANDS, BAND_ROWS = 32, 6
#: Bytes of shingle sets in a tile.
TILE_BYTES = 16 << 20


# --- fingerprints -----------------------------------------------------------


def mix(values):
    """A 64-bit finaliser (the constants are those of the public splitmix64)."""
    import numpy as np

    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(text: bytes, width: int):
    """XXH64 of every run of ``width`` words joined by spaces; of the whole sequence if it is shorter."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, HASH_SEED)], dtype=np.uint64)
    ends = list(itertools.accumulate(map((1).__add__, map(len, words)), initial=0))
    return np.fromiter(
        (xxh64_intdigest(joined[a : b - 1], HASH_SEED) for a, b in zip(ends, itertools.islice(ends, width, None))),
        dtype=np.uint64, count=len(words) - width + 1,
    )


def _lanes():
    """For each byte, its bits as eight counters in one 64-bit number."""
    import numpy as np

    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(hashes, words: int, lanes) -> bytes:
    """Majority bits; further words use the hashes mixed with the word's number."""
    import numpy as np

    counts = np.zeros(64 * words, dtype=np.int64)
    if len(hashes):
        steps = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for at in range(0, len(hashes), 255):  # a lane counts up to 255
            some = hashes[at : at + 255, None]
            if words > 1:
                some = np.concatenate([some, mix(some + steps[1:])], axis=1)
            counts += lanes[np.ascontiguousarray(some).view(np.uint8)].sum(axis=0).view(np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, width: int, words: int) -> DataFrame:
    """doc_id, text_key, fp of every row."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def prints(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lanes = _lanes()
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), width), words, lanes) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.binary())], names=["doc_id", "text_key", "fp"]
            )

    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), common.text_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(prints, f"doc_id {key}, text_key bigint, fp binary")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


# --- links ------------------------------------------------------------------


def cell_masks(words: int, radius: int, rows: int) -> list[tuple[int, int]]:
    """(word, mask) of each kind of cell.

    One word: cut into ``radius + agree`` blocks, of which ``agree`` are left whole by ``radius``
    different bits; more blocks make longer keys, for more rows.
    """
    if words > 1:
        return [(w, 0xFFFF << (16 * b)) for w in range(words) for b in range(4)]
    agree = 1 if rows <= 1 << 22 else 2 if rows <= 1 << 31 else 3
    edges = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [(0, sum(some)) for some in itertools.combinations(blocks, agree)]


def references(words: int):
    """The fixed reference fingerprints: zero (which counts bits), and pseudo-random ones."""
    import numpy as np

    numbers = np.arange(1, (REFERENCES - 1) * words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate([np.zeros((1, words), dtype=np.uint64), mix(numbers).reshape(-1, words)])


def distances(a, b):
    import numpy as np

    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def cell_roots(group, fps, radius: int, refs):
    """For each row the first row of its part of its cell; ``group`` holds ascending cell numbers."""
    import numpy as np

    count = len(group)
    roots = np.arange(count)
    table = np.stack([distances(fps, r) for r in refs], axis=1)
    sizes = np.bincount(group)
    small = np.flatnonzero(sizes[group] <= SMALL_CELL)
    left, right = [], []
    shift, here = 1, small
    while len(here):
        here = here[here + shift < count]
        here = here[group[here + shift] == group[here]]
        near = here[np.abs(table[here, 0] - table[here + shift, 0]) <= radius]
        near = near[(np.abs(table[near] - table[near + shift]) <= radius).all(axis=1)]
        near = near[distances(fps[near], fps[near + shift]) <= radius]
        left.append(near)
        right.append(near + shift)
        shift += 1
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while len(a):
            low = np.minimum(roots[a], roots[b])
            if (low == roots[a]).all() and (low == roots[b]).all():
                break
            np.minimum.at(roots, a, low)
            np.minimum.at(roots, b, low)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for g in np.flatnonzero(sizes > SMALL_CELL):
        waiting = np.arange(starts[g], starts[g + 1])
        while len(waiting):
            root, reached = waiting[0], [waiting[0]]
            waiting = waiting[1:]
            while reached and len(waiting):
                x = reached.pop()
                near = np.flatnonzero(np.abs(table[waiting, 0] - table[x, 0]) <= radius)
                near = near[(np.abs(table[waiting[near]] - table[x]) <= radius).all(axis=1)]
                near = near[distances(fps[waiting[near]], fps[x]) <= radius]
                if len(near):
                    found = waiting[near]
                    roots[found] = root
                    reached.extend(found.tolist())
                    waiting = np.delete(waiting, near)
    return roots


def cells_of(fps: DataFrame, masks: list[tuple[int, int]], words: int) -> DataFrame:
    """kind, key, fp: every fingerprint in each of its cells."""

    def deal(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                column = batch.column(0).slice(at, 4096)
                values = np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, words)
                for kind, (word, mask) in enumerate(masks):
                    keys = (values[:, word] & np.uint64(mask)).view(np.int64)
                    kinds = np.full(len(keys), kind, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kinds), pa.array(keys), column], names=["kind", "key", "fp"]
                    )

    return fps.select("fp").mapInArrow(deal, "kind int, key bigint, fp binary")


def tiled(cells: DataFrame) -> DataFrame:
    """Adds the tile: hot cells are cut so that every pair of their rows meets in some tile."""
    sizes = cells.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE_ROWS)
    hot = materialize(sizes, "hot-cells")
    if hot.isEmpty():
        return cells.withColumn("tile", F.lit(0).cast("long"))
    parts = F.coalesce(F.ceil(F.col("n") / TILE_ROWS), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts)
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.least(own, k) * parts + F.greatest(own, k))
    return cells.join(hot, ["kind", "key"], "left").select("kind", "key", "fp", F.explode(tiles).alias("tile"))


def linked(fps: DataFrame, radius: int, words: int) -> DataFrame:
    """a, b: links that hold together all fingerprints within ``radius`` that share a cell."""
    masks = cell_masks(words, radius, fps.count())
    cell = ["kind", "key", "tile"]
    dealt = tiled(cells_of(fps, masks, words)).repartition(*cell).sortWithinPartitions(*cell, "fp")

    def link(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        refs = references(words)

        def links_of(keys, raw):
            """Links in whole cells: sorted rows of (kind, key, tile), and their fingerprints."""
            new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            group, raw = np.unique(group[many], return_inverse=True)[1], raw[many]
            if len(raw):
                roots = cell_roots(group, raw, radius, refs)
                child = np.flatnonzero(roots != np.arange(len(roots)))
                both = [pa.array([r.tobytes() for r in raw[i]], pa.binary()) for i in (child, roots[child])]
                yield pa.RecordBatch.from_arrays(both, names=["a", "b"])

        keys = np.zeros((0, 3), dtype=np.int64)
        raw = np.zeros((0, words), dtype=np.uint64)
        for batch in batches:
            more = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in cell], axis=1)
            values = b"".join(batch.column(batch.schema.get_field_index("fp")).to_pylist())
            keys = np.concatenate([keys, more.astype(np.int64)])
            raw = np.concatenate([raw, np.frombuffer(values, dtype="<u8").reshape(-1, words)])
            if len(keys):
                whole = int(np.argmax((keys == keys[-1]).all(axis=1)))  # the last cell may go on
                if whole:
                    yield from links_of(keys[:whole], raw[:whole])
                    keys, raw = keys[whole:], raw[whole:]
        if len(keys):
            yield from links_of(keys, raw)

    return dealt.mapInArrow(link, "a binary, b binary")


def components(docs: DataFrame, width: int, words: int, radius: int) -> DataFrame:
    """doc_id, text_key, fp, component_id (the smallest doc_id reachable) of every row."""
    rows = materialize(fingerprints(docs, width, words), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected(linked(nodes, radius, words))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = materialize(nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "first", "root"), "members")
    smallest = members.groupBy("root").agg(F.min("first").alias("smallest"))
    named = members.join(smallest, "root").select("fp", "smallest")
    every = nodes.join(named, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    return rows.join(every, "fp").select("doc_id", "text_key", "fp", "component_id")


# --- near copies of whole documents -----------------------------------------


def shingle_set(text: bytes, width: int):
    """The distinct shingle hashes, ascending."""
    import numpy as np

    return np.unique(shingle_hashes(text, width))


def band_keys(hashes, multipliers):
    """A key for every band: a hash of its number and of the least products of the hashes with its multipliers."""
    import numpy as np

    least = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (multipliers[:, None] * hashes[None, at : at + 256]).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return keys


def minhash_multipliers():
    """Fixed odd numbers; the shingle hashes are random, so that a product puts them in a random order."""
    import numpy as np

    return mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, node (a digest of the shingle set), bands, fp (the fingerprint) of every row."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        multipliers, lanes = minhash_multipliers(), _lanes()
        for batch in batches:
            nodes, bands, fps = [], [], []
            for text in batch.column(2):
                hashes = shingle_set(text.as_py(), width)
                fps.append(fingerprint(shingle_hashes(text.as_py(), PRINT_SHINGLE), PRINT_WORDS, lanes))
                nodes.append(xxh3_128_digest(hashes.tobytes()))
                bands.append(band_keys(hashes, multipliers).view("int64"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(fps, pa.binary())],
                names=["doc_id", "text_key", "node", "bands", "fp"],
            )
        common.give_back()

    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), common.text_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(sketch, f"doc_id {key}, text_key bigint, node binary, bands array<bigint>, fp binary")


def with_roots(links: DataFrame) -> DataFrame:
    """node, root of every linked node, the roots among them."""
    roots = connected(links)
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """a, b: links of nodes (node, fp) whose fingerprints are within the radius, by cells and pivots as in :func:`components`."""
    prints = materialize(prints.distinct(), "node-prints")
    first = materialize(prints.groupBy("fp").agg(F.min("node").alias("b")), "print-nodes")
    equal = prints.join(first, "fp").filter("node <> b").select(F.col("node").alias("a"), "b")
    near = linked(first, RADIUS, PRINT_WORDS)
    for end in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(end), F.col("b").alias(f"of_{end}")), end)
    return equal.unionByName(near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))


def band_links(nodes: DataFrame) -> DataFrame:
    """a, b: links of all nodes that share a band with another."""
    cells = nodes.select("node", F.explode("bands").alias("key"))
    ends = cells.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top"))
    shared = materialize(ends.filter("b <> top").select("key", "b"), "shared-bands")
    return cells.join(common.sent_if_small(shared, F.lit(32)), "key").select(F.col("node").alias("a"), "b")


def candidate_components(nodes: DataFrame, prints: DataFrame) -> DataFrame:
    """node, root of all nodes linked by their fingerprints or by a shared band, by components of these links."""
    return with_roots(fingerprint_links(prints).unionByName(band_links(nodes)))


def similar_roots(sets, similarity: float):
    """For each of some sets (ascending hashes) the first one that pairs of at least ``similarity`` lead to."""
    import numpy as np

    count = len(sets)
    roots = np.arange(count)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owners = np.repeat(np.arange(count), sizes)[np.argsort(ids, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    own = np.split(ids, np.cumsum(sizes)[:-1])
    waiting = np.ones(count, dtype=bool)
    for first in range(count):
        if not waiting[first]:
            continue
        waiting[first], reached = False, [first]
        while reached and waiting.any():
            x = reached.pop()
            held = [owners[starts[i] : starts[i + 1]] for i in own[x]]
            common_of = np.bincount(np.concatenate(held), minlength=count) if held else np.zeros(count, dtype=np.int64)
            either = np.maximum(sizes + sizes[x] - common_of, 1)
            found = np.flatnonzero(waiting & (common_of / either >= similarity))
            roots[found] = first
            waiting[found] = False
            reached.extend(found.tolist())
    return roots


def verified_links(sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that hold together all pairs of one candidate component (root) that are near copies."""
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("bytes") / TILE_BYTES))
    hot = materialize(sizes.select("root", parts.alias("parts")).filter("parts > 1"), "hot-components")
    cut = F.coalesce(F.col("parts"), F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("node"), cut)
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), cut - 1), lambda k: F.least(own, k) * cut + F.greatest(own, k))
    dealt = sets.join(common.sent_if_small(hot, F.lit(32)), "root", "left").select("root", F.explode(tiles).alias("tile"), "node", "shingles")
    dealt = dealt.repartition("root", "tile").sortWithinPartitions("root", "tile", "node")

    def link(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def links_of(held):
            roots = similar_roots([np.frombuffer(x, dtype=np.uint64) for _, x in held], similarity)
            child = np.flatnonzero(roots != np.arange(len(held)))
            both = [pa.array([held[i][0] for i in some], pa.binary()) for some in (child, roots[child])]
            return pa.RecordBatch.from_arrays(both, names=["a", "b"])

        at, held = None, []
        for batch in batches:
            for root, tile, node, shingles in zip(*batch.columns):
                here = (root.as_py(), tile.as_py())
                if here != at and len(held) > 1:
                    yield links_of(held)
                if here != at:
                    at, held = here, []
                held.append((node.as_py(), shingles.as_py()))
        if len(held) > 1:
            yield links_of(held)
        held.clear()
        common.give_back()

    return dealt.mapInArrow(link, "a binary, b binary")


def near_groups(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, text_key, node, root (the node that stands for its group of near copies) of every row."""
    sketched = materialize(sketches(docs, width), "sketches")
    nodes = materialize(sketched.groupBy("node").agg(F.first("bands").alias("bands")), "nodes")
    rows = sketched.select("doc_id", "text_key", "node")
    members = materialize(candidate_components(nodes, sketched.select("node", "fp")), "candidates")
    texts = rows.join(common.sent_if_small(members, F.lit(48)), "node").groupBy("node", "root").agg(F.min("text_key").alias("of_text"))
    texts = common.sent_if_small(materialize(texts, "candidate-texts"), F.lit(56))
    wanted = docs.select(text_key(F.col("text")).alias("of_text"), common.text_bytes(F.col("text")).alias("text")).join(texts, "of_text")

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), width).tobytes() for t in some.column(2)]
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(sets, pa.binary())], names=["node", "root", "shingles"])
        common.give_back()

    sets = wanted.select("node", "root", "text").mapInArrow(gather, "node binary, root binary, shingles binary")
    sets = materialize(sets.dropDuplicates(["node"]), "shingle-sets")
    roots = common.sent_if_small(materialize(with_roots(verified_links(sets, similarity)), "groups"), F.lit(48))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of every group of near copies: of the smallest doc_id (null last), then the least text_key.

    Groups are told apart by their root, so that null or repeated ids bring no others together.
    """
    keys = [common.fresh_name(docs.columns, n) for n in ("near_doc", "near_key")]
    found = materialize(near_groups(docs, width, similarity), "near")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    counts = materialize(found.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    first = counts.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    first = materialize(first.filter("rows > 1").select("root", "first"), "near-first")
    gone = counts.join(common.sent_if_small(first, F.lit(48)), "root").filter(order != F.col("first"))
    gone = common.sent_if_small(materialize(gone.select("doc_id", "text_key").toDF(*keys), "near-dropped"), F.lit(32))

    def same(rows: DataFrame, listed: DataFrame) -> Column:
        return rows["doc_id"].eqNullSafe(listed[keys[0]]) & (text_key(rows["text"]) == listed[keys[1]])

    kept = docs.join(gone, same(docs, gone), "left_anti")
    repeated = materialize(counts.filter("n > 1").select("doc_id", "text_key").toDF(*keys), "repeated-rows")
    if repeated.isEmpty():
        return kept
    twice = common.sent_if_small(repeated, F.lit(32))
    one = kept.join(twice, same(kept, twice), "left_semi").withColumn(keys[1], text_key(F.col("text")))
    one = one.dropDuplicates(["doc_id", keys[1]]).drop(keys[1])
    return kept.join(twice, same(kept, twice), "left_anti").unionByName(one)


def op1_simhash_pivots(spark: SparkSession, sf: str) -> DataFrame:
    found = components(common.table(spark, sf, "documents").select("doc_id", "text"), PRINT_SHINGLE, PRINT_WORDS, RADIUS)
    low_first = F.lower(F.hex("fp"))
    digits = F.concat(*[F.substring(low_first, at, 2) for at in range(15, 0, -2)])
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
