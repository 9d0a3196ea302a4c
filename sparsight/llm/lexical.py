"""Ranked lexical search by MaxScore with pair bounds.

The index is cut by document.  A shard holds the postings of some tens of thousands of documents and,
for pairs of terms that queries use together, the list of documents that hold both, with the sum of the
two impacts and its maximum.  A word that stands in every document is thus spread over all shards, and a
search moves nothing but the best hits of each task.

A query's terms stand in one order, the heaviest last.  The longest prefix whose documents cannot reach
the k-th best score so far is not read for candidates.  Its bound pairs neighbouring terms: a document
outside of their intersection list has at most the larger of both maxima, one inside has its stored joint
impact; of all ways to pair neighbours the best is taken.  Documents of the lists that may still reach the
score become candidates by name.  Candidates are then completed from the heaviest prefix term down and
dropped when the joint maxima of what is left no longer suffice.  Without pair lists the bounds are those
of independent term maxima; the hits are the same.

Weights are integers: w = floor(1000 ln((2N+2)/(2df+1))), impact w * ((10^9 tf) div (1000 tf + 12 m)) with
m = 75 + (25 n N) div L, so scores are exact and do not depend on the cut.

Defined results: a null or empty text has no terms, counts in no statistic and is no hit; every row of the
documents is a document and every row of the items an item, equal ones too; equal scores stand by ascending
doc_id, null ids last; an item without terms, or without hits, has no rows; empty tables give no rows; other
columns are not read.  Texts of any length are split in slices of a megabyte.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparsight.llm import common
from sparsight.storage import materialize

TOP_K = 20
#: Bounds of a shard; a task builds or searches one at a time.
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 65_536
#: Pairs of terms are listed when the rarer one is in at most this part of the documents.
PAIR_SHARE = 0.125
#: Bytes of item text that are sent to the tasks at once; each such block reads the index once.
ITEM_BYTES = 8 << 20
#: Bytes of a text that are split at once.
SLICE = 1 << 20

#: Digits, letters (A-Z lower-cased) and all bytes beyond ASCII stay; anything else separates terms.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def term_counts(text: bytes) -> tuple[int, Counter]:
    """Number of terms with repeats, and how often each occurs."""
    text = text.translate(TERM_BYTES)
    counts, n, start = Counter(), 0, 0
    while start < len(text):
        stop = start + SLICE
        cut = text.find(b" ", stop) if stop < len(text) else -1
        stop = len(text) if cut < 0 else cut
        words = text[start:stop].split()
        counts.update(words)
        n += len(words)
        start = stop
    return n, counts


def weight(df: int, documents: int) -> int:
    return math.floor(1000.0 * math.log((2.0 * documents + 2.0) / (2.0 * df + 1.0)))


# -- forward table and statistics ------------------------------------------------------------------


def forward(docs: DataFrame, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """doc_id, n, terms, counts of every document with a term; only terms of the vocabulary where one is given."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    names = f"doc_id {doc_type}, n bigint, terms array<string>, counts array<int>"
    known = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def split(stream):
        for batch in stream:
            rows, ns, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                if not text.is_valid:
                    continue
                n, found = term_counts(text.as_buffer().to_pybytes())
                if n:
                    held = sorted(found.keys() & known.value if known is not None else found)
                    rows.append(i)
                    ns.append(n)
                    terms.append([t.decode() for t in held])
                    counts.append([found[t] for t in held])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()),
                 pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(split, names)


def item_terms(items: DataFrame) -> DataFrame:
    """row, terms, counts of every item; ``row`` tells equal items apart."""

    def split(stream):
        for batch in stream:
            made = [term_counts((t or "").encode())[1] for t in batch.column("text").to_pylist()]
            held = [sorted(c) for c in made]
            terms = pa.array([[t.decode() for t in h] for h in held], pa.list_(pa.string()))
            counts = pa.array([[c[t] for t in h] for c, h in zip(made, held)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("row"), terms, counts], names=["item_id", "row", "terms", "counts"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return materialize(rows.mapInArrow(split, f"item_id {kind}, row bigint, terms array<string>, counts array<int>"), "items")


def small_vocabulary(items: DataFrame) -> frozenset[bytes] | None:
    """The items' terms where they may be sent to every task, else None: all terms are indexed."""
    terms = materialize(items.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    total = terms.agg(F.sum(F.octet_length("term") + 60)).first()[0] or 0
    return frozenset(r.term.encode() for r in terms.collect()) if total <= common.SEND_BYTES else None


@dataclass(frozen=True)
class Statistics:
    documents: int
    terms: int
    #: term, df
    frequencies: DataFrame

    def weights_of(self, wanted: Iterable[str]) -> dict[str, int]:
        """Weights of a bounded list of terms; those in no document are left out."""
        spark = self.frequencies.sparkSession
        asked = spark.createDataFrame([(t,) for t in wanted], "term string")
        rows = self.frequencies.join(F.broadcast(asked), "term").collect()
        return {r.term: weight(r.df, self.documents) for r in rows}


def statistics_of(table: DataFrame) -> Statistics:
    """N, L and document frequencies of a written forward table."""
    documents, terms = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    counted = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Statistics(documents, terms or 0, materialize(counted, "frequencies"))


# -- shards ----------------------------------------------------------------------------------------


@dataclass
class Shard:
    """Postings of some documents, which stand by ascending id; lists of pairs by the numbers of their terms."""

    doc_ids: pa.Array
    terms: pa.Array
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    tops: np.ndarray
    pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]

    def posting(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[term], self.starts[term + 1])
        return self.docs[at], self.impacts[at]


def built_shard(parts: list[pa.RecordBatch], documents: int, terms: int) -> Shard:
    """A shard without pair lists from rows of the forward table."""
    table = pa.Table.from_batches(parts)
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending")])  # nulls last
    table = table.take(order).combine_chunks()
    column = lambda c: table[c].chunk(0) if isinstance(table[c], pa.ChunkedArray) else table[c]
    flat = column("terms").flatten().dictionary_encode()
    names = flat.dictionary
    by_name = pc.sort_indices(names).to_numpy()
    place = np.empty(len(names), np.int64)
    place[by_name] = np.arange(len(names))
    code = place[flat.indices.to_numpy(zero_copy_only=False)]
    size = column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(table.num_rows), size)
    tf = column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    length = np.array([75 + 25 * n * documents // terms for n in column("n").to_pylist()], np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * length[doc])
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(names) + 1))
    tops = np.maximum.reduceat(impact[order], starts[:-1]) if len(names) else np.empty(0, np.int64)
    return Shard(column("doc_id"), names.take(pa.array(by_name)), starts, doc[order].astype(np.int32), impact[order], tops, {})


def with_pair_lists(shard: Shard, pairs: list[tuple[str, str, int, int]]) -> Shard:
    """Adds the intersection list of every pair (term, term, weight, weight) with both terms in the shard."""
    flat = pa.array([t for p in pairs for t in p[:2]], pa.string())
    codes = pc.fill_null(pc.index_in(flat, value_set=shard.terms), -1).to_numpy()
    for (_, _, w, x), a, b in zip(pairs, codes[::2].tolist(), codes[1::2].tolist()):
        if a < 0 or b < 0:
            continue
        (docs, impacts), (others, other_impacts) = shard.posting(a), shard.posting(b)
        if len(docs) > len(others):
            docs, impacts, others, other_impacts, w, x = others, other_impacts, docs, impacts, x, w
        at = np.searchsorted(others, docs)
        at[at == len(others)] = 0
        met = others[at] == docs
        shard.pairs[a, b] = docs[met], w * impacts[met] + x * other_impacts[at[met]]
    return shard


_SHARD = "terms array<string>, starts array<int>, docs array<int>, impacts array<int>, tops array<int>, pair_a array<int>, pair_b array<int>, pair_starts array<int>, pair_docs array<int>, pair_joint array<bigint>, pair_top array<bigint>"


def shard_row(shard: Shard, schema: pa.Schema) -> pa.RecordBatch:
    keys = list(shard.pairs)
    lists = [shard.pairs[k] for k in keys]
    flat = lambda i, t: np.concatenate([x[i] for x in lists]) if lists else np.empty(0, t)
    tops = [int(joint.max()) if len(joint) else 0 for _, joint in lists]
    values = [
        shard.doc_ids, shard.terms, shard.starts, shard.docs, shard.impacts, shard.tops, [k[0] for k in keys], [k[1] for k in keys],
        np.cumsum([0, *(len(x[0]) for x in lists)]), flat(0, np.int32), flat(1, np.int64), tops,
    ]
    columns = []
    for field, value in zip(schema, values):
        inner = value if isinstance(value, pa.Array) else pa.array(value, field.type.value_type)
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner.cast(field.type.value_type)))
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def read_shard(batch: pa.RecordBatch, row: int) -> Shard:
    value = lambda c: batch.column(c)[row].values
    number = lambda c: value(c).to_numpy(zero_copy_only=False)
    starts, docs, joint = number("pair_starts"), number("pair_docs"), number("pair_joint")
    pairs = {
        (a, b): (docs[starts[i] : starts[i + 1]], joint[starts[i] : starts[i + 1]])
        for i, (a, b) in enumerate(zip(number("pair_a").tolist(), number("pair_b").tolist()))
    }
    impacts = number("impacts").astype(np.int64)
    return Shard(value("doc_ids"), value("terms"), number("starts"), number("docs"), impacts, number("tops").astype(np.int64), pairs)


def build_shards(table: DataFrame, stats: Statistics, pairs: list[tuple[str, str, int, int]]) -> DataFrame:
    """The index, a row per shard, from a written forward table; tasks cut the rows they read."""
    doc_type = table.schema["doc_id"].dataType.simpleString()
    names = f"doc_ids array<{doc_type}>, {_SHARD}"
    schema = to_arrow_schema(table.sparkSession.createDataFrame([], names).schema)
    documents, terms = stats.documents, stats.terms
    sent = table.sparkSession.sparkContext.broadcast(pairs)

    def build(stream):
        def made(parts):
            return shard_row(with_pair_lists(built_shard(parts, documents, terms), sent.value), schema)

        parts, postings, rows = [], 0, 0
        for batch in stream:
            size = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                room = SHARD_POSTINGS - postings + (size[start - 1] if start else 0)
                stop = min(max(int(np.searchsorted(size, room, side="right")), start + (not parts)), start + SHARD_DOCS - rows)
                if stop > start:
                    parts.append(batch.slice(start, stop - start))
                    postings += int(size[stop - 1] - (size[start - 1] if start else 0))
                    rows, start = rows + stop - start, stop
                if start < batch.num_rows:
                    yield made(parts)
                    parts, postings, rows = [], 0, 0
        if parts:
            yield made(parts)

    return materialize(table.filter(F.size("terms") > 0).mapInArrow(build, names), "lexical-index")


# -- search ----------------------------------------------------------------------------------------


def chain(terms: Iterable[tuple[str, int]]) -> list[str]:
    """Terms of a query by ascending weight: pair lists are kept of its neighbours."""
    return [t for t, _ in sorted(terms, key=lambda x: (x[1], x[0]))]


def best_pairing(tops: list[int], joint: list[int | None]) -> tuple[list[int], list[bool]]:
    """Least bound of each prefix of a chain when neighbours may be paired, and whether its last two terms are.

    ``joint[i]`` bounds what terms i - 1 and i add together; None where they cannot be paired.
    """
    bounds, paired = [0], [False]
    for i, top in enumerate(tops):
        alone = bounds[i] + top
        both = bounds[i - 1] + joint[i] if i and joint[i] is not None else None
        paired.append(both is not None and both < alone)
        bounds.append(both if paired[-1] else alone)
    return bounds, paired


class ItemSearch:
    """Best hits of one item over the shards of a task."""

    def __init__(self, terms: list[str], weights: list[int], repeats: list[int], k: int):
        self.terms, self.weights, self.repeats, self.k = terms, weights, repeats, k
        self.scores, self.ids, self.visited = np.empty(0, np.int64), None, 0

    @property
    def edge(self) -> int:
        """A score below this cannot be among the best any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, shard: Shard, codes: list[int], use_pairs: bool = True) -> None:
        held = [(c, w, r) for c, w, r in zip(codes, self.weights, self.repeats) if c >= 0]
        if not held:
            return
        code, w, r = ([x[i] for x in held] for i in range(3))
        tops = [w[i] * r[i] * int(shard.tops[c]) for i, c in enumerate(code)]
        edge = max([self.edge, *(self._floor(shard.posting(c)[1], w[i] * r[i]) for i, c in enumerate(code))])
        lists, apart, joint = [None] * len(code), [None] * len(code), [None] * len(code)
        for i in range(1, len(code)):
            found = shard.pairs.get((code[i - 1], code[i])) if use_pairs else None
            if found is not None:
                # Joint impacts are those of single terms; what one is repeated more often comes on top.
                least = min(r[i - 1], r[i])
                rest = sum((r[j] - least) * w[j] * int(shard.tops[code[j]]) for j in (i - 1, i))
                lists[i] = found[0], least * found[1] + rest
                apart[i] = max(tops[i - 1], tops[i])
                joint[i] = max(apart[i], int(lists[i][1].max()) if len(found[0]) else 0)
                edge = max(edge, self._floor(found[1], least))
        bounds, paired = best_pairing(tops, joint)
        sizes = [int(shard.starts[c + 1] - shard.starts[c]) for c in code]
        prefix, read, outside = self._prefix(bounds, paired, edge, sizes, lists, apart, joint)
        total = np.zeros(len(shard.doc_ids), np.int64)
        more = np.zeros(len(shard.doc_ids), np.int64)
        for i in read:
            docs, sums = lists[i]
            self.visited += len(docs)
            more[docs] += np.maximum(sums - apart[i], 0)
        for i in range(prefix, len(code)):
            docs, impacts = shard.posting(code[i])
            self.visited += len(docs)
            total[docs] += w[i] * r[i] * impacts
        # Documents of the prefix alone come in by their joint impacts, or not at all.
        ready = np.flatnonzero(((total > 0) | (more > 0)) & (total + outside + more >= edge))
        for i in range(prefix - 1, -1, -1):
            if len(ready) >= self.k:
                edge = max(edge, int(np.partition(total[ready], len(ready) - self.k)[len(ready) - self.k]))
            ready = ready[total[ready] + bounds[i + 1] >= edge]
            if not len(ready):
                return
            docs, impacts = shard.posting(code[i])
            at = np.searchsorted(docs, ready)
            at[at == len(docs)] = 0
            met = docs[at] == ready
            self.visited += len(ready)
            total[ready[met]] += w[i] * r[i] * impacts[at[met]]
        self._merge(shard, ready[total[ready] >= edge], total)

    @staticmethod
    def _prefix(bounds, paired, edge, sizes, lists, apart, joint) -> tuple[int, list[int], int]:
        """Length of the prefix that is not read for candidates, the pair lists read instead, and the bound outside of them.

        Joint maxima cost nothing; beyond the prefix they allow, a longer one is taken where the lists that
        make its bound small enough are shorter than the postings it saves.
        """
        prefix = max(i for i in range(len(bounds)) if i == 0 or bounds[i] < edge)
        cost = sum(sizes[prefix:])
        best = cost, prefix, [], bounds[prefix]
        for i in range(prefix + 1, len(bounds)):
            pairs, at = [], i
            while at:
                if paired[at] and joint[at - 1] > apart[at - 1]:
                    pairs.append(at - 1)
                at -= 2 if paired[at] else 1
            pairs.sort(key=lambda p: len(lists[p][0]) / (joint[p] - apart[p]))
            bound, read, length = bounds[i], [], sum(sizes[i:])
            for p in pairs:
                if bound < edge:
                    break
                bound -= joint[p] - apart[p]
                length += len(lists[p][0])
                read.append(p)
            if bound < edge and length < best[0]:
                best = length, i, read, bound
        return best[1:]

    def _floor(self, impacts: np.ndarray, factor: int) -> int:
        """The k-th largest of impacts of different documents: so many score at least this."""
        if len(impacts) < self.k or not factor:
            return 1
        at = len(impacts) - self.k
        return factor * int(np.partition(impacts, at)[at])

    def _merge(self, shard: Shard, docs: np.ndarray, total: np.ndarray) -> None:
        if len(docs) > self.k:
            edge = np.partition(total[docs], len(docs) - self.k)[len(docs) - self.k]
            docs = docs[total[docs] >= edge]
        found = shard.doc_ids.take(pa.array(docs))
        scores = np.concatenate([self.scores, total[docs]])
        ids = found if self.ids is None else pa.concat_arrays([self.ids, found])
        order = pc.sort_indices(
            pa.table({"score": scores, "id": ids}), sort_keys=[("score", "descending"), ("id", "ascending")]
        )[: self.k]
        self.scores, self.ids = scores[order.to_numpy()], ids.take(order)


def search_shards(shards: Iterable[Shard], items: list[tuple[list[str], list[int], list[int]]], k: int, use_pairs: bool = True) -> list[ItemSearch]:
    """The best hits of items (terms in chain order, weights, repeats) over shards."""
    words = sorted({t for terms, _, _ in items for t in terms})
    number = {t: i for i, t in enumerate(words)}
    asked = [[number[t] for t in terms] for terms, _, _ in items]
    searches = [ItemSearch(*item, k) for item in items]
    for shard in shards:
        codes = pc.fill_null(pc.index_in(pa.array(words, pa.string()), value_set=shard.terms), -1).to_pylist()
        for search, wanted in zip(searches, asked):
            search.add(shard, [codes[i] for i in wanted], use_pairs)
    return searches


def blocks_of_items(items: DataFrame):
    """The written items in lists of bounded bytes."""
    size = items.agg(F.sum(F.aggregate("terms", F.lit(64).cast("long"), lambda n, t: n + F.octet_length(t) + 24))).first()[0] or 0
    blocks = common.pieces(size, ITEM_BYTES)
    # Rows of a task are numbered one after the other, so a hash of the number is even.
    for i in range(blocks):
        yield items.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).collect()


def item_chain(row, weights: dict[str, int]) -> tuple[list[str], list[int], list[int]]:
    repeats = dict(zip(row.terms, row.counts))
    terms = chain((t, weights[t]) for t in row.terms if t in weights)
    return terms, [weights[t] for t in terms], [repeats[t] for t in terms]


def pairs_of(items: DataFrame, stats: Statistics) -> list[tuple[str, str, int, int]]:
    """Neighbours in the chains of the items, the most frequent pairs first, as far as they may be sent to all tasks.

    Terms of which the rarer is in more than PAIR_SHARE of the documents are left out: their list is long and
    tightens little.  A pair without a list is bounded by the maxima of its terms.
    """
    limit = weight(math.floor(PAIR_SHARE * stats.documents), stats.documents)
    found = Counter()
    for block in blocks_of_items(items):
        weights = stats.weights_of({t for r in block for t in r.terms})
        for row in block:
            terms, w, _ = item_chain(row, weights)
            found.update(p for p in zip(terms, terms[1:], w, w[1:]) if p[3] >= limit)
    kept, size = [], 0
    for pair, _ in found.most_common():
        size += len(pair[0]) + len(pair[1]) + 200
        if size > common.SEND_BYTES:
            break
        kept.append(pair)
    return kept


def search(index: DataFrame, stats: Statistics, items: DataFrame, k: int = TOP_K) -> DataFrame:
    """item_id, row, rank, doc_id, score: the k best documents of every item (from :func:`item_terms`)."""
    kind, doc = items.schema["item_id"].dataType.simpleString(), index.schema["doc_ids"].dataType.elementType.simpleString()
    names = f"item_id {kind}, row bigint, doc_id {doc}, score bigint"
    schema = to_arrow_schema(index.sparkSession.createDataFrame([], names).schema)
    hits = None
    for block in blocks_of_items(items):
        weights = stats.weights_of({t for r in block for t in r.terms})
        asked = [item_chain(r, weights) for r in block]
        sent = index.sparkSession.sparkContext.broadcast((asked, [r.item_id for r in block], [r.row for r in block]))

        def task(stream, sent=sent):
            asked, ids, rows = sent.value
            shards = (read_shard(b, i) for b in stream for i in range(b.num_rows))
            for item, row, found in zip(ids, rows, search_shards(shards, asked, k)):
                if len(found.scores):
                    n = len(found.scores)
                    columns = [[item] * n, [row] * n, found.ids, found.scores]
                    columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        part = index.mapInArrow(task, names)
        hits = part if hits is None else hits.unionByName(part)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "row", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP_K) -> DataFrame:
    """Indexes ``docs`` (doc_id, text) for the terms of ``items`` (item_id, text) and searches them."""
    asked = item_terms(items)
    table = materialize(forward(docs, small_vocabulary(asked)), "forward")
    stats = statistics_of(table)
    return search(build_shards(table, stats, pairs_of(asked, stats)), stats, asked, k)


def op11_pair_maxscore(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = common.table(spark, sf, "documents"), common.table(spark, sf, "benchmark")
    return rank_documents(docs, items).select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{_TERM}')"
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
o AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM d),
p AS (SELECT doc_id, term, n, count(*) AS tf FROM o GROUP BY ALL),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {TOP_K}
"""
