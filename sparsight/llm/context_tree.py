"""Language-model scores by context-tree weighting over bytes, beside a word unigram base.

Each byte is eight binary decisions; a decision's node is the bits of the byte so far, in a context of
0 to ``depth`` preceding bytes.  Every node estimates its next bit by Krichevsky-Trofimov and mixes
that with its children, the contexts one byte longer, by the weights that context-tree weighting gives
them after all training texts.  Block probabilities depend on counts alone, so the counts of
(depth + 1)-byte runs, summed up in Spark over the whole corpus, are all that training needs.

* Counting: tasks pre-aggregate runs and words; Spark sums them.
* Weights: runs are dealt by the two bytes before the predicted one, whose subtrees are whole in one
  task (at most 256^3 runs, however large the corpus); the top two levels (65,280 nodes) are joined in the driver.
* Scoring: the log probability of every run that occurs, seen in training or not, is a table.  Its most
  frequent rows, a bounded number, are sent to the tasks; the rest, occurrences of rare runs and words,
  meets the table in a join.  Nothing is left out: a head covers most occurrences, the join the others.

The text is the UTF-8 with A-Z lower-cased, followed by one end symbol; the score is the probability of
all of it.  Trained counts are fixed while scoring.

Defined results: a null or empty text is the end symbol alone; without training texts every bit has
probability one half and the base is 0; repeated rows are scored each for itself; a null doc_id counts
as the empty text when rows are held out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.storage import materialize

DEPTH = 4
FOLDS, HELD_OUT = 7, 2
#: Rows of the tables that are sent to tasks, at most.
HEAD_RUNS, HEAD_WORDS = 1_000_000, 200_000
#: Distinct runs and words a task holds before it hands them on; runs in a task of the weighting.
HOLD_RUNS, HOLD_WORDS, TASK_RUNS = 1_000_000, 200_000, 250_000
TEXT_SLICE = 1 << 20
#: Ends a text and pads its first contexts; never part of UTF-8.
END = 0xFF


# --- runs of bytes ----------------------------------------------------------


def runs_of(texts: list[bytes], depth: int):
    """Codes of all runs (context bytes, then the predicted byte lowest) and the first index of each text."""
    import numpy as np

    pad, end = bytes([END]) * depth, bytes([END])
    raw = np.frombuffer(b"".join([p for t in texts for p in (pad, t, end)]), dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    if depth > 7:
        raise ValueError("a run has at most eight bytes")
    count = len(raw) - depth
    codes = np.zeros(count, dtype=np.uint64)
    for at in range(depth + 1):
        codes <<= np.uint64(8)
        codes |= raw[at : at + count]
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.ones(count, dtype=bool)
    later = firsts[1:] + depth * np.arange(len(texts) - 1)  # runs that end in a later text's padding
    inside[(later[:, None] + np.arange(depth)).ravel()] = False
    return codes[inside], firsts


def summed(keys, counts):
    import numpy as np

    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, weights=counts).astype(np.int64)


def gather(docs: DataFrame, depth: int) -> DataFrame:
    """run, word, n: training counts by task; runs of held-out texts have n = 0."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from collections import Counter

        def emit(runs=None, words=None):
            if runs is not None:
                size = len(runs[0])
                columns = [pa.array(runs[0].view(np.int64)), pa.nulls(size, pa.binary()), pa.array(runs[1], pa.int64())]
            else:
                size = len(words)
                columns = [pa.nulls(size, pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["run", "word", "n"])

        words: Counter = Counter()
        parts: list = []
        held = 0
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for out in (False, True):
                texts = [t for h, t in rows if h == out]
                for some in common.runs_of(texts, map(len, texts), TEXT_SLICE):
                    low = [t.lower() for t in some]
                    keys, counts = np.unique(runs_of(low, depth)[0], return_counts=True)
                    parts.append((keys, counts * (not out)))
                    held += len(keys)
                    if not out:
                        for t in low:
                            words.update(t.split())
                    if held > HOLD_RUNS:
                        merged = summed(*map(np.concatenate, zip(*parts)))
                        parts, held = [merged], len(merged[0])
                        if held > HOLD_RUNS // 2:
                            yield emit(runs=merged)
                            parts, held = [], 0
                    if len(words) > HOLD_WORDS:
                        yield emit(words=words)
                        words.clear()
        if parts:
            yield emit(runs=summed(*map(np.concatenate, zip(*parts))))
        if words:
            yield emit(words=words)

    return docs.select("held_out", "text").mapInArrow(count, "run bigint, word binary, n bigint")


# --- the tree ---------------------------------------------------------------


def log_kt(zeros, ones):
    """Natural log of the Krichevsky-Trofimov probability of a block with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - _LOG_PI


_LOG_PI = 1.1447298858494002  # of 2 * log_gamma(1/2)


def _log_gamma(x):
    """Stirling's series, after shifting small arguments up; for x >= 0.5."""
    import numpy as np

    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift = shift + np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    y = 1.0 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + series - shift


def weighted(own, children):
    """Log of the even mixture of a node's own block probability and its children's product."""
    import numpy as np

    return np.logaddexp(own, children) - np.log(2.0)


def subtree_mixture(runs, counts, depth: int):
    """For whole subtrees below two context bytes.

    Returns the probabilities (runs x 8) of the bits of each run's last byte as mixed at depth 2, and
    for the nodes at depth 1: key (byte << 8 | node), sum of log weighted probabilities, zeros, ones.
    """
    import numpy as np

    byte = (runs & np.uint64(0xFF)).astype(np.int64)
    mixed = np.empty((len(runs), 8))
    tops = []
    for bit in range(8):
        node = (1 << bit) | (byte >> (8 - bit))
        value = (byte >> (7 - bit)) & 1
        below = None
        levels = []
        for level in range(depth, 1, -1):
            context = (runs >> np.uint64(8)) & np.uint64((1 << (8 * level)) - 1)
            keys, place = np.unique((context << np.uint64(8)) | node.astype(np.uint64), return_inverse=True)
            ones = np.bincount(place, weights=counts * value, minlength=len(keys))
            total = np.bincount(place, weights=counts, minlength=len(keys))
            own = log_kt(total - ones, ones)
            if below is None:
                whole = own
            else:
                first = np.zeros(len(below[0]), dtype=np.int64)
                first[below[1]] = place  # the node of a child is the node of any of its runs
                whole = weighted(own, np.bincount(first, weights=below[2], minlength=len(keys)))
            levels.append((place, ones, total, own, whole))
            below = (keys, place, whole)
        chance = None
        for place, ones, total, own, whole in levels:
            kt = (np.where(value == 1, ones[place], total[place] - ones[place]) + 0.5) / (total[place] + 1.0)
            if chance is None:
                chance = kt
            else:
                share = np.exp(own - whole - np.log(2.0))[place]
                chance = share * kt + (1 - share) * chance
        mixed[:, bit] = chance
        place, ones, total, _, whole = levels[-1]
        keys = below[0]
        top = (((keys >> np.uint64(8)) & np.uint64(0xFF)) << np.uint64(8)) | (keys & np.uint64(0xFF))
        top, at = np.unique(top.astype(np.int64), return_inverse=True)
        sums = [np.bincount(at, weights=w) for w in (whole, total - ones, ones)]
        tops.append((top, *sums))
    return mixed, [np.concatenate(t) for t in zip(*tops)]


def top_levels(keys, whole, zeros, ones):
    """Dense (byte, node) shares and estimates of bit 1 at depth 1, and the same at depth 0 by node."""
    import numpy as np

    dense = [np.zeros(1 << 16) for _ in range(3)]
    for target, values in zip(dense, (whole, zeros, ones)):
        target[keys] = values
    whole, zeros, ones = dense
    own = log_kt(zeros, ones)
    all_1 = weighted(own, whole)
    share_1, kt_1 = np.exp(own - all_1 - np.log(2.0)), (ones + 0.5) / (zeros + ones + 1.0)
    sums = [x.reshape(256, 256).sum(axis=0) for x in (all_1, zeros, ones)]
    own = log_kt(sums[1], sums[2])
    share_0, kt_0 = np.exp(own - weighted(own, sums[0]) - np.log(2.0)), (sums[2] + 0.5) / (sums[1] + sums[2] + 1.0)
    return share_1, kt_1, share_0, kt_0


def log10_of_runs(runs, mixed, top):
    import numpy as np

    share_1, kt_1, share_0, kt_0 = top
    byte = (runs & np.uint64(0xFF)).astype(np.int64)
    before = ((runs >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
    total = np.zeros(len(runs))
    for bit in range(8):
        node = (1 << bit) | (byte >> (8 - bit))
        value = (byte >> (7 - bit)) & 1
        at = (before << 8) | node
        chance = mixed[:, bit]
        chance = share_1[at] * np.where(value == 1, kt_1[at], 1 - kt_1[at]) + (1 - share_1[at]) * chance
        chance = share_0[node] * np.where(value == 1, kt_0[node], 1 - kt_0[node]) + (1 - share_0[node]) * chance
        total += np.log10(chance)
    return total


def run_scores(counts: DataFrame, depth: int) -> DataFrame:
    """run, n, logp (log10) from run, n."""
    tasks = common.pieces(counts.count(), TASK_RUNS)
    two = F.shiftright("run", 8).bitwiseAND(F.lit(0xFFFF))

    def mix(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        runs, seen = (np.concatenate(x) for x in zip(*parts))
        mixed, (keys, whole, zeros, ones) = subtree_mixture(runs.view(np.uint64), seen.astype(np.float64), depth)
        names = ["run", "n", "mixed", "node", "whole", "zeros", "ones"]
        bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(64), len(runs), [None, pa.py_buffer(np.ascontiguousarray(mixed))])
        for at in range(0, len(runs), 65536):
            size = min(65536, len(runs) - at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[at : at + size]), pa.array(seen[at : at + size]), bits.slice(at, size).cast(pa.binary()),
                 pa.nulls(size, pa.int64()), *[pa.nulls(size, pa.float64())] * 3], names=names)
        size = len(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()),
             pa.array(keys), pa.array(whole), pa.array(zeros), pa.array(ones)], names=names)

    schema = "run bigint, n bigint, mixed binary, node bigint, whole double, zeros double, ones double"
    found = materialize(counts.select("run", "n").repartition(tasks, two).mapInArrow(mix, schema), "subtrees")
    nodes = found.filter("node IS NOT NULL").groupBy("node").agg(F.sum("whole"), F.sum("zeros"), F.sum("ones"))
    import numpy as np

    rows = nodes.collect()  # at most 256 * 255
    columns = [np.array([r[i] for r in rows], dtype=t) for i, t in enumerate((np.int64, float, float, float))]
    top = counts.sparkSession.sparkContext.broadcast(top_levels(*columns))

    def finish(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            runs = batch.column(0).to_numpy()
            mixed = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float64).reshape(-1, 8)
            logp = log10_of_runs(runs.view(np.uint64), mixed, top.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logp)], names=["run", "n", "logp"])

    return found.filter("run IS NOT NULL").select("run", "n", "mixed").mapInArrow(finish, "run bigint, n bigint, logp double")


# --- tables of bounded size for the tasks -----------------------------------


class RunTable:
    """Run codes to log probabilities: open addressing in arrays."""

    def __init__(self, keys, values):
        import numpy as np

        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.filled = np.zeros(size, dtype=bool)
        self.keys = np.zeros(size, dtype=np.uint64)
        self.values = np.zeros(size)
        place = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            at = place[left]
            free = ~self.filled[at]
            at_free, who = at[free], left[free]
            _, first = np.unique(at_free, return_index=True)
            put = who[first]
            self.filled[place[put]] = True
            self.keys[place[put]] = keys[put]
            self.values[place[put]] = values[put]
            done = np.zeros(len(keys), dtype=bool)
            done[put] = True
            left = left[~done[left]]
            place[left] = (place[left] + 1) & (size - 1)

    def _slot(self, codes):
        import numpy as np

        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes):
        """Values of the codes, NaN where a code is not in the table."""
        import numpy as np

        place = self._slot(codes)
        found = np.where(self.keys[place] == codes, self.values[place], np.nan)
        found[~self.filled[place]] = np.nan
        left = np.flatnonzero(self.filled[place] & (self.keys[place] != codes))
        at = place[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.filled[at] & (self.keys[at] == codes[left])
            found[left[hit]] = self.values[at[hit]]
            on = self.filled[at] & ~hit
            left, at = left[on], at[on]
        return found


def head_of(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest ``n``: all of them, or those from the least power of two that leaves ``most``."""
    sizes = {r["p"]: r["rows"] for r in counts.groupBy(F.floor(F.log2(F.col("n") + 1)).alias("p")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    if sum(sizes.values()) <= most:
        return counts
    kept, least = 0, max(sizes) + 1
    for power in sorted(sizes, reverse=True):
        if kept + sizes[power] > most:
            break
        kept, least = kept + sizes[power], power
    return counts.filter(F.floor(F.log2(F.col("n") + 1)) >= least)


@dataclass
class Model:
    """runs (run, n, logp) and words (word, n) of the training texts, as written tables."""

    depth: int
    runs: DataFrame
    words: DataFrame
    train_tokens: int
    train_texts: int
    vocabulary: int


def fit(docs: DataFrame, depth: int = DEPTH) -> Model:
    """Learns from rows of ``docs`` (held_out, text binary) that are not held out."""
    if not 2 <= depth <= 7:
        raise ValueError("depth must lie between 2 and 7")
    gathered = materialize(gather(docs, depth), "counts")
    runs = materialize(gathered.filter("run IS NOT NULL").groupBy("run").agg(F.sum("n").alias("n")), "runs")
    words = materialize(gathered.filter("run IS NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    said = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    texts = docs.filter("NOT held_out").count()
    scored = materialize(run_scores(runs, depth), "run-scores")
    return Model(depth, scored, words, (said[0] or 0) + texts, texts, said[1] + bool(texts))


_TABLES: dict = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    import uuid

    import numpy as np

    context, depth, name = docs.sparkSession.sparkContext, model.depth, uuid.uuid4().hex
    run_head, word_head = head_of(model.runs, HEAD_RUNS), head_of(model.words, HEAD_WORDS)
    runs = run_head.select("run", "logp").toArrow()
    words = word_head.select("word", "n").toArrow()
    sent = context.broadcast((
        runs.column(0).to_numpy().view(np.uint64), runs.column(1).to_numpy(),
        b" ".join(words.column(0).to_pylist()), np.log10(words.column(1).to_numpy() + 1.0),
    ))
    key = docs.schema["doc_id"].dataType.simpleString()

    def look_up(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from collections import Counter

        if name not in _TABLES:
            _TABLES.clear()
            keys, values, known, logs = sent.value
            _TABLES[name] = RunTable(keys, values), dict(zip(known.split(), logs.tolist()))
            del keys, values, known, logs
        table, heads = _TABLES[name]
        get = heads.get
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
                 pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for some in common.runs_of(rows, (len(t) for _, _, t in rows), TEXT_SLICE):
                low = [t.lower() for _, _, t in some]
                codes, firsts = runs_of(low, depth)
                logs = table.find(codes)
                rare = np.flatnonzero(np.isnan(logs))
                logs[rare] = 0.0
                sums = np.add.reduceat(logs, firsts).tolist()
                owner = np.searchsorted(firsts, rare, side="right") - 1
                edges = np.searchsorted(owner, np.arange(len(some) + 1))
                out: list[list] = [[] for _ in types]
                for i, text in enumerate(low):
                    tokens = text.split()
                    base = [get(w) for w in tokens]
                    if None in base:
                        other = Counter(w for w, x in zip(tokens, base) if x is None)
                        base = [x for x in base if x is not None]
                    else:
                        other = {}
                    if edges[i] < edges[i + 1]:
                        far, times = np.unique(codes[rare[edges[i] : edges[i + 1]]].view(np.int64), return_counts=True)
                    else:
                        far = times = ()
                    row = (len(text) + 1, len(tokens) + 1, len(base), sum(base), sums[i], list(other), list(other.values()), far, times)
                    for column, value in zip(out, row):
                        column.append(value)
                ids = pa.array([r[0] for r in some], batch.schema.field(0).type)
                held = pa.array([r[1] for r in some], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [ids, held, *[pa.array(c, t) for c, t in zip(out, types)]],
                    names=["doc_id", "held_out", "n_bytes", "n_tokens", "head_known", "head_base", "head_score",
                           "far_words", "far_counts", "far_runs", "far_times"],
                )

    schema = (
        f"doc_id {key}, held_out boolean, n_bytes bigint, n_tokens bigint, head_known bigint, head_base double, head_score double,"
        " far_words array<binary>, far_counts array<bigint>, far_runs array<bigint>, far_times array<bigint>"
    )
    partial = docs.select("doc_id", "held_out", "text").mapInArrow(look_up, schema)
    # The row number is written with the row, so it is the same in all that follows.
    partial = materialize(partial.withColumn("row", F.monotonically_increasing_id()), "partial-scores")
    far = partial.select("row", F.explode(F.arrays_zip("far_words", "far_counts")).alias("x"))
    far = far.select("row", F.col("x.far_words").alias("word"), F.col("x.far_counts").alias("times"))
    rare_words = model.words.join(word_head.select("word"), "word", "left_anti") if word_head is not model.words else model.words.limit(0)
    word_part = far.join(rare_words, "word").groupBy("row").agg(
        F.sum("times").alias("far_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("far_base")
    )
    runs_far = partial.select("row", F.explode(F.arrays_zip("far_runs", "far_times")).alias("x"))
    runs_far = runs_far.select("row", F.col("x.far_runs").alias("run"), F.col("x.far_times").alias("times"))
    run_part = runs_far.join(model.runs.select("run", "logp"), "run").groupBy("row").agg(
        F.sum(F.col("times") * F.col("logp")).alias("far_score")
    )
    end_known = F.lit(1 if model.train_texts else 0)
    norm = F.log10(F.lit(float(model.train_tokens + model.vocabulary + 1)))
    all_of = partial.drop("far_words", "far_counts", "far_runs", "far_times").join(word_part, "row", "left").join(run_part, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = F.col("head_score") + zero("far_score")
    return all_of.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("far_known", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("far_base") + F.log10(F.lit(model.train_texts + 1.0)) - F.col("n_tokens") * norm).alias("base_score"),
        total.alias("score"), (-total / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def with_folds(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", (common.remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        common.text_bytes(F.col("text")).alias("text"),
    )


def op6_context_tree(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_folds(common.table(spark, sf, "documents"))
    return score(docs, fit(docs))
