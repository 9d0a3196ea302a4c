"""Benchmark decontamination by a generalised suffix automaton over words.

The words of all test items make one automaton; the words of a document are streamed through it,
keeping the length of the longest suffix that occurs in an item.  Where that length reaches the
window (13 words), the window ending there is hit; items shorter than a window count as a whole.
Words that no item has cannot be part of a window, so only runs of known words are streamed.

Items are sent to the tasks in blocks of bounded size (``BLOCK_BYTES`` of item text), and all
documents are held against every block; with one block that is one pass without any shuffle, with
more of them the spans of a document are merged by its key.

Defined results: a null or empty text has no words and is clean; repeated items count once per id;
an item without id marks words but is not listed; repeated documents are judged each for itself; an
empty benchmark leaves everything clean; further columns are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.storage import materialize

WINDOW = 13
#: A document is contaminated if its hit words times this reach its words.
COVERAGE_PARTS = 20
BLOCK_BYTES = 2 << 20
#: Everything but digits, letters and bytes above 127 parts words; A-Z is lower-cased.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
SPAN = "array<struct<start: int, stop: int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class SuffixAutomaton:
    """All word runs of the items, with the windows that count marked at their states."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        number = self.vocabulary.setdefault
        coded = [(item, [number(w, len(self.vocabulary)) for w in words_of(text)]) for item, text in items]
        coded = [(item, words) for item, words in coded if words]
        self.shortest = min([window, *(len(w) for _, w in coded)])
        for _, words in coded:
            state = 0
            for word in words:
                state = self._extend(state, word)
        states = range(len(self.next))
        by_length = sorted(states, key=self.length.__getitem__)
        #: The state holding the last ``window`` words of each state's longest run.
        self.window_state = [-1] * len(self.next)
        for state in by_length:
            if self.length[state] >= window:
                above = self.link[state]
                self.window_state[state] = state if self.length[above] < window else self.window_state[above]
        self.items: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for item, words in coded:
            state = 0
            for at, word in enumerate(words):
                state = self.next[state][word]
                if at + 1 >= window:
                    self.items.setdefault(self.window_state[state], set()).add(item)
            if len(words) < window:
                self.short.setdefault(state, []).append((len(words), item))
        #: The nearest state on the way to the root, itself included, that ends a short item.
        self.short_state = [-1] * len(self.next)
        for state in by_length:
            self.short_state[state] = state if state in self.short else self.short_state[self.link[state]] if state else -1

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, target: int, word: int) -> int:
        """A copy of ``target`` for the runs that reach it from ``state`` and its suffixes."""
        copy = self._new(self.length[state] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, state: int, word: int) -> int:
        target = self.next[state].get(word)
        if target is not None:
            return target if self.length[target] == self.length[state] + 1 else self._split(state, target, word)
        new, at = self._new(self.length[state] + 1), state
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, target, word)
        return new

    def stream(self, words: list[int], offset: int, spans: list[list[int]], items: set) -> None:
        """Adds the hit spans (start, stop) of known words, in order, and the items found."""
        step, link, length = self.next, self.link, self.length
        state, matched, window = 0, 0, self.window
        found: set[int] = set()
        for at, word in enumerate(words, offset + 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            longest = 0
            if matched >= window:
                longest = window
                found.add(self.window_state[state])
            near = self.short_state[state]
            while near > 0:
                for size, item in self.short[near]:
                    if size <= matched:
                        longest = max(longest, size)
                        items.add(item)
                near = self.short_state[link[near]]
            if longest:
                start = at - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, at])
        for state in found:
            items |= self.items[state]

    def scan(self, text: bytes) -> tuple[int, list[list[int]], set]:
        """Number of words, hit spans over words, items whose windows occur."""
        import numpy as np

        words = words_of(text)
        spans: list[list[int]] = []
        items: set = set()
        if len(words) >= self.shortest and self.vocabulary:
            get = self.vocabulary.get
            coded = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
            border = np.flatnonzero(np.diff(np.concatenate([[False], coded >= 0, [False]]).astype(np.int8)))
            starts, stops = border[::2], border[1::2]
            for i in np.flatnonzero(stops - starts >= self.shortest):
                self.stream(coded[starts[i] : stops[i]].tolist(), int(starts[i]), spans, items)
        return len(words), spans, items


_BUILT: dict = {}


def built(key: str, items: list, window: int) -> SuffixAutomaton:
    """The automaton of a block, built once per worker process; one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton(items, window)
    return _BUILT[key]


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hit_rows(docs: DataFrame, block: DataFrame, window: int, all_rows: bool) -> DataFrame:
    """doc_id, text_key, n_words, spans, items of documents (only those hit, unless ``all_rows``)."""
    import uuid

    items = [(r[0], bytes(r[1])) for r in block.collect()]
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    key = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = built(name, sent.value, window)
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            rows = []
            for doc, text_hash, text in zip(*((x.as_py() for x in column) for column in batch.columns[:3])):
                n, spans, found = automaton.scan(text)
                if spans or all_rows:
                    listed = sorted(i for i in found if i is not None)
                    rows.append((doc, text_hash, n, [{"start": a, "stop": b} for a, b in spans], listed))
            types = (batch.schema.field(0).type, pa.int64(), pa.int64(), span, pa.list_(pa.string()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "text_key", "n_words", "spans", "items"]
            )

    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), common.text_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {key}, text_key bigint, n_words bigint, spans {SPAN}, items array<string>")


def merged(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones joined."""
    apart = lambda done, s: (F.size(done) == 0) | (F.element_at(done, -1)["stop"] < s["start"])
    joined = lambda done, s: F.concat(
        F.slice(done, 1, F.size(done) - 1),
        F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"),
            F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop"),
        )),
    )
    step = lambda done, s: F.when(apart(done, s), F.concat(done, F.array(s))).otherwise(joined(done, s))
    return F.aggregate(F.sort_array(spans), F.array().cast(SPAN), step)


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_key, n_words, spans (over words), items of every row of ``docs``."""
    items = benchmark.filter("text IS NOT NULL AND text <> ''").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")
    ).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = common.pieces(total, block_bytes)
    if blocks == 1:
        return hit_rows(docs, items, window, True)
    placed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    part = lambda i: placed.filter(F.col("block") == i).drop("block")
    rows = hit_rows(docs, part(0), window, True)
    for i in range(1, blocks):
        rows = rows.unionByName(hit_rows(docs, part(i), window, False).withColumn("n_words", F.lit(None).cast("long")))
    found = rows.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"),
        merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return found.select("doc_id", "text_key", "n_words", "spans", "items", copies.alias("copy")).drop("copy")


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * COVERAGE_PARTS >= F.col("n_words"))


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of the spans; white space left on both sides becomes one space."""
    import re

    raw = text.encode()
    places = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", raw.translate(WORD_TABLE))]
    parts, at = [], 0
    for s in spans:
        parts.append(raw[at : places[s["start"]][0]])
        at = places[s["stop"] - 1][1]
    parts.append(raw[at:])
    return b" ".join(p.strip(b" ") for p in parts).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents below the coverage limit, without the spans that occur in test items."""
    hit = find_spans(docs, benchmark, window).withColumn("n_hit", n_hit()).filter("n_hit > 0")
    names = [common.fresh_name(docs.columns, n) for n in ("hit_doc", "hit_key", "hit_spans", "hit_bad")]
    hit = materialize(hit.select("doc_id", "text_key", "spans", contaminated()).distinct().toDF(*names), "contaminated")
    hit = common.sent_if_small(hit, 48 + 16 * F.size(names[2]))

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        return pd.Series([cut_spans(t, s) if s is not None else t for t, s in zip(text, spans)], dtype=object)

    same = docs["doc_id"].eqNullSafe(hit[names[0]]) & (text_key(docs["text"]) == hit[names[1]])
    left = docs.join(hit, same, "left").filter(~F.coalesce(F.col(names[3]), F.lit(False)))
    text = F.when(F.col(names[2]).isNull(), docs["text"]).otherwise(cut(docs["text"], F.col(names[2])))
    return left.select([text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op2_suffix_automaton(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = common.table(spark, sf, "documents"), common.table(spark, sf, "benchmark")
    found = find_spans(docs, items).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{_W}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{_W}') AS w FROM benchmark),
x AS (SELECT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, t.i, t.i + least(len(w), {WINDOW}) - 1), ' ') AS win
      FROM b, generate_series(1, greatest(len(w) - {WINDOW} + 1, 1)) AS t(i) WHERE len(w) > 0),
z AS (SELECT DISTINCT n FROM x),
g AS (SELECT doc_id, t.i AS i, z.n AS n, array_to_string(list_slice(w, t.i, t.i + z.n - 1), ' ') AS win
      FROM d, z, generate_series(1, len(w) - z.n + 1) AS t(i) WHERE len(w) >= z.n),
h AS (SELECT DISTINCT doc_id, i, g.n, item_id FROM g JOIN x ON g.win = x.win AND g.n = x.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {COVERAGE_PARTS} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
