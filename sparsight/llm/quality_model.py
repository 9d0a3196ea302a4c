"""A generalised additive model with pairwise interactions that scores text quality.

Features of a whole text are measured once, in one pass, and stored.  The model is fitted on a bounded
sample of labelled rows (``SAMPLE_ROWS``; above it, the rows with the least hashes of their ids): cyclic
boosting gives each feature in turn a shallow tree on its bins, whose leaves are added to the feature's
lookup table; the pairs of features that explain most of what is left then get tables over coarse bins
in the same way.  All documents are scored by adding up table entries, vectorised over rows.

Labels, language, source and ids are never features.

Defined results: a null text is an empty text, which is measured and scored like any other; a document
with several labels counts as good if half of them are; labels other than 0 and 1 are left out; without
labels every score is 0.5; repeated rows are scored alike; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.storage import materialize

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: The bound of the sample that the model is fitted on.
SAMPLE_ROWS = 50_000
BINS, COARSE_BINS = 64, 8
MAIN_ROUNDS, PAIR_ROUNDS, PAIRS = 40, 60, 10
RATE, PENALTY, SPLITS = 0.2, 2.0, 3

#: Classes of bytes whose share is a feature.
BYTE_CLASSES = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&<>@^~_=+\\/{}[]", "bars": b"|",
    "shouts": b"!?", "stops": b".", "commas": b",;:", "spaces": b" \t\n\x0b\x0c\r", "line_ends": b"\n", "quotes": b"\"'`",
    "high": bytes(range(128, 256)), "control": bytes(range(9)) + bytes(range(14, 32)),
}
WORD_FEATURES = ("log_bytes", "log_words", "word_length", "distinct", "distinct_pairs", "echoes", "capital_words", "full_lines", "line_words")
FEATURES = (*BYTE_CLASSES, *WORD_FEATURES)


# --- features ---------------------------------------------------------------


def class_table():
    import numpy as np

    table = np.zeros((256, len(BYTE_CLASSES)))
    for at, members in enumerate(BYTE_CLASSES.values()):
        table[list(members), at] = 1.0
    return table


def features_of(text: bytes, table) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    import math
    from itertools import islice
    from operator import eq

    import numpy as np

    size = len(text)
    shares = (np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ table / max(size, 1)).tolist()
    words = text.split()
    count = len(words)
    some, pairs = max(count, 1), max(count - 1, 1)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        *shares,
        math.log1p(size), math.log1p(count), sum(map(len, words)) / some, len(set(words)) / some,
        len(set(zip(words, islice(words, 1, None)))) / pairs, sum(map(eq, words, islice(words, 1, None))) / pairs,
        sum(map(bytes.isupper, words)) / some, sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines) / max(len(lines), 1),
        math.log1p(count / max(len(lines), 1)),
    ]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, features of every row."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = class_table()
        for batch in batches:
            rows = [features_of(t.as_py(), table) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"]
            )

    rows = docs.select("doc_id", common.text_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {key}, features array<double>")


# --- the model --------------------------------------------------------------


@dataclass
class AdditiveModel:
    """A start value, and tables of log odds for bins of features and coarse bins of pairs."""

    start: float
    edges: list
    tables: list
    coarse: list
    pairs: list

    def bins(self, x):
        import numpy as np

        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def log_odds(self, x):
        import numpy as np

        bins = self.bins(x)
        total = np.full(len(x), self.start)
        for table, at in zip(self.tables, bins):
            total += table[at]
        for a, b, table in self.pairs:
            total += table[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return total

    def score(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def gain(g, h):
    return g * g / (h + PENALTY)


def best_split(g, h, lo: int, hi: int):
    """The cut of bins [lo, hi) that gains most: (gain, cut)."""
    import numpy as np

    if hi - lo < 2:
        return 0.0, lo
    left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
    gains = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
    at = int(np.argmax(gains))
    return float(gains[at]), lo + at + 1


def line_tree(g, h):
    """Leaf values, by bin, of the greedy tree with ``SPLITS`` cuts on one feature."""
    import numpy as np

    parts = [(0, len(g))]
    for _ in range(SPLITS):
        (value, cut), (lo, hi) = max((best_split(g, h, lo, hi), (lo, hi)) for lo, hi in parts)
        if value <= 0:
            break
        parts.remove((lo, hi))
        parts += [(lo, cut), (cut, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + PENALTY)
    return out


def grid_tree(g, h):
    """Leaf values on a grid: one cut of an axis, then one cut of the other on either side."""
    import numpy as np

    best = None
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        first, cut = best_split(gg.sum(axis=1), hh.sum(axis=1), 0, len(gg))
        cut = cut or 1
        out, total = np.zeros_like(gg), first
        for rows in (slice(0, cut), slice(cut, None)):
            a, b = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
            more, at = best_split(a, b, 0, len(a))
            total += more
            for columns in (slice(0, at), slice(at, None)):
                out[rows, columns] = a[columns].sum() / (b[columns].sum() + PENALTY)
        if best is None or total > best[0]:
            best = total, out.T if turned else out
    return best[1]


def fit_model(x, y) -> AdditiveModel:
    import numpy as np
    from itertools import combinations

    width = len(FEATURES)
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], quantiles)) if len(x) else np.zeros(0) for f in range(width)]
    model = AdditiveModel(start, edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    model.coarse = [np.arange(len(e) + 1) * COARSE_BINS // (len(e) + 1) for e in edges]
    if not len(x):
        return model
    bins = model.bins(x)
    total = np.full(len(y), start)

    def pulls():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(MAIN_ROUNDS):
        for f in range(width):
            pull, bend = pulls()
            size = len(model.tables[f])
            step = RATE * line_tree(np.bincount(bins[f], pull, size), np.bincount(bins[f], bend, size))
            model.tables[f] += step
            total += step[bins[f]]
    coarse = [c[b] for c, b in zip(model.coarse, bins)]
    pull, bend = pulls()
    cells = COARSE_BINS * COARSE_BINS
    gains = []
    for a, b in combinations(range(width), 2):
        at = coarse[a] * COARSE_BINS + coarse[b]
        gains.append((float(gain(np.bincount(at, pull, cells), np.bincount(at, bend, cells)).sum()), a, b))
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pairs = [(a, b, np.zeros((COARSE_BINS, COARSE_BINS))) for a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            pull, bend = pulls()
            at = coarse[a] * COARSE_BINS + coarse[b]
            grids = [np.bincount(at, w, cells).reshape(COARSE_BINS, COARSE_BINS) for w in (pull, bend)]
            step = RATE * grid_tree(*grids)
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def sample_of(measured: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple:
    """Features and labels of at most about ``rows`` labelled rows outside the held-out fold.

    Rows with the same id and features count once, however often they are repeated.
    """
    import numpy as np

    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("double").alias("good")
    )
    known = known.filter(common.remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    found = known.count()
    if found > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / found * (1 << 30)))
    joined = measured.join(known, "doc_id").select("doc_id", "features", "good").dropDuplicates(["doc_id", "features"])
    joined = materialize(joined.withColumn("mark", F.xxhash64("doc_id", "features")), "labelled")
    found = joined.count()
    if found > rows:  # ids with many different rows
        joined = joined.filter(F.pmod("mark", F.lit(1 << 30)) < int(rows / found * (1 << 30)))
    got = joined.toArrow()
    order = np.argsort(got.column("mark").to_numpy(), kind="stable")
    order = order[np.argsort(got.column("doc_id").to_numpy()[order], kind="stable")]
    x = np.array(got.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return x[order], got.column("good").to_numpy()[order]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    measured = materialize(measure(docs), "features")
    model = measured.sparkSession.sparkContext.broadcast(fit_model(*sample_of(measured, labels)))

    @F.pandas_udf("double")
    def score(features):
        import numpy as np
        import pandas as pd

        if not len(features):
            return pd.Series([], dtype="float64")
        return pd.Series(model.value.score(np.stack(features.to_numpy())))

    held = common.remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    scored = measured.select("doc_id", held.alias("held_out"), score("features").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_additive_model(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
