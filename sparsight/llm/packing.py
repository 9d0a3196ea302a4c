"""Documents packed into sequences of fixed capacity by fitted length patterns.

Every text is tokenised in the tasks; ids and texts stay there.  The histogram of piece lengths
(at most ``capacity`` rows) goes to the driver, which chooses patterns: multisets of up to four
different lengths, short ones repeated, that nearly fill a sequence.  How often each is used is fitted to the histogram by
non-negative least squares, rounded down and held to what is there; the rest is packed by best
fit, whole runs of equal patterns at a time.  The plan is a list of runs: so many pieces of one
length go to so many consecutive sequences at one offset.  Pieces are numbered in order of their
length by a distributed sort, and each looks up its run.

Defined results: a null or empty text is one piece holding the end id alone; equal rows are
packed each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.storage import materialize

CAPACITY, END_ID = 4096, 1
#: Steps of the fit, and lengths tried as second and third member of a pattern.
FIT_STEPS, PARTNERS = 200, 12
TEXT_SLICE = 1 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache_words: int = 600_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every text."""
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def cut(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from sparsight.llm.tokens import word_tokens

        tokens, last = word_tokens(path, cache_words), end_id.to_bytes(4, "little")
        for batch in batches:
            for some in common.byte_slices(batch, 1, TEXT_SLICE):
                out: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(some.column(0).to_pylist(), tokens.encode(some.column(1).to_pylist())):
                    ids += last
                    for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, number, at // 4, len(part) // 4, zlib.crc32(part), part)):
                            column.append(value)
                types = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t, _ in zip(out, types, names)], names=names)
        common.give_back()

    return docs.select("doc_id", common.text_bytes(F.col("text")).alias("text")).mapInArrow(cut, schema)


# --- the plan, on the histogram ---------------------------------------------


def patterns(counts, capacity: int):
    """Rows of up to four lengths (0: none) that nearly fill ``capacity``, from lengths that occur; and how often each is taken."""
    import numpy as np

    present = np.flatnonzero(counts)
    if not len(present):
        return np.zeros((0, 4), dtype=np.int64), np.zeros((0, 4), dtype=np.int64)

    def fitting(room, back=0):
        at = np.searchsorted(present, room, side="right") - 1 - back
        return np.where(at >= 0, present[np.maximum(at, 0)], 0)

    share = np.cumsum(counts[present]) / counts.sum()
    spread = np.unique(present[np.searchsorted(share, (np.arange(PARTNERS) + 0.5) / PARTNERS)])
    none = np.zeros_like(present)
    found = [np.stack([present, fitting(capacity - present, back), none, none], 1) for back in range(3)]
    for second in spread:
        two = present + second
        third = fitting(capacity - two)
        found.append(np.stack([present, none + second, third, none], 1)[two <= capacity])
        for other in spread[::3]:
            three = two + other
            found.append(np.stack([present, none + second, none + other, fitting(capacity - three)], 1)[three <= capacity])
    rows = np.sort(np.concatenate(found), axis=1)
    taken = [(rows > 0).astype(np.int64)]
    # Short lengths as often as they fit, alone and in half of the room beside another.
    short = present[5 * present <= capacity]
    for second in [0, *spread[5 * spread <= capacity]]:
        times = np.minimum((capacity if not second else capacity // 2) // short, counts[short])
        room = capacity - times * short
        more = np.minimum(room // second, counts[second]) if second else np.zeros_like(short)
        room = room - more * second
        third = fitting(room)
        fourth = fitting(room - third)
        rows = np.concatenate([rows, np.stack([short, second + np.zeros_like(short), third, fourth], 1)])
        taken.append(np.stack([times, more, third > 0, fourth > 0], 1).astype(np.int64))
    times = np.concatenate(taken)
    rows = np.where(times > 0, rows, 0)
    total = (rows * times).sum(axis=1)
    near = (total <= capacity) & (total >= capacity - capacity // 50)
    both = np.unique(np.concatenate([rows[near], times[near]], axis=1), axis=0)
    return both[:, :4], both[:, 4:]


def fitted_repeats(rows, taken, counts):
    """Non-negative least squares of pattern repeats against the histogram, by projected steps."""
    import numpy as np

    size = len(counts)
    target = counts.astype(np.float64)
    target[0] = 0.0
    flat = rows.ravel()
    present = taken.astype(np.float64)
    weight = 1.0 / np.maximum(np.bincount(flat, weights=present.ravel(), minlength=size), 1.0)  # rows of the system scaled alike
    x = np.zeros(len(rows))
    ahead, momentum = x.copy(), 1.0
    for _ in range(FIT_STEPS):
        made = np.bincount(flat, weights=(ahead[:, None] * present).ravel(), minlength=size)
        short = (target - made) * weight
        short[0] = 0.0
        step = (short[rows] * present).sum(axis=1) / np.maximum(present.sum(axis=1), 1.0)
        new = np.maximum(ahead + step * 0.5, 0.0)
        momentum, was = (1 + (1 + 4 * momentum**2) ** 0.5) / 2, momentum
        ahead = np.maximum(new + (was - 1) / momentum * (new - x), 0.0)
        x = new
    return x


def fitted_plan(counts, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], object]:
    """(pattern, repeats) of the fitted patterns, and the histogram of what they leave."""
    import numpy as np

    left = np.array(counts, dtype=np.int64)
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rows, taken = patterns(left, capacity)
    if len(rows):
        x = fitted_repeats(rows, taken, left)
        order = np.lexsort((-x, capacity - (rows * taken).sum(axis=1)))
        for i in order[np.floor(x[order]) >= 1]:
            members, times = np.unique(np.repeat(rows[i], taken[i]), return_counts=True)
            repeats = int(min(np.floor(x[i]), (left[members] // times).min()))
            if repeats > 0:
                left[members] -= repeats * times
                plan.append((tuple(np.repeat(members, times).tolist()), repeats))
    return plan, left


def fitted_share(counts, capacity: int = CAPACITY) -> float:
    """The share of pieces that fitted patterns place."""
    total = int(sum(counts))
    return 1.0 - int(fitted_plan(counts, capacity)[1].sum()) / total if total else 0.0


def plan_packing(counts, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) whose lengths together are exactly the histogram ``counts``."""
    import bisect

    import numpy as np

    plan, left = fitted_plan(counts, capacity)
    present = np.flatnonzero(left).tolist()
    rest = {length: int(left[length]) for length in present}
    while present:
        used: dict[int, int] = {}
        room, members = capacity, []
        while True:
            at = bisect.bisect_right(present, room) - 1
            while at >= 0 and used.get(present[at], 0) >= rest[present[at]]:
                at -= 1
            if at < 0:
                break
            length = present[at]
            used[length] = used.get(length, 0) + 1
            members.append(length)
            room -= length
        repeats = min(rest[length] // n for length, n in used.items())
        plan.append((tuple(members), repeats))
        for length, n in used.items():
            rest[length] -= repeats * n
            if not rest[length]:
                del rest[length]
                present.remove(length)
    return plan


def runs_of_plan(plan: list[tuple[tuple[int, ...], int]]):
    """Arrays (first rank, first sequence, offset) of the runs, in order of length.

    Pieces ranked by length fall into consecutive runs: the piece of rank ``first + i`` goes to
    sequence ``sequence + i``.
    """
    import numpy as np

    runs, sequence = [], 0
    for members, repeats in plan:
        offset = 0
        for length in members:
            runs.append((length, sequence, offset, repeats))
            offset += length
        sequence += repeats
    runs.sort()
    lengths, sequences, offsets, repeats = np.array(runs, dtype=np.int64).reshape(-1, 4).T
    return np.concatenate([[0], np.cumsum(repeats)[:-1]]).astype(np.int64), sequences, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, length (1 to ``capacity``) and more."""
    pieces = materialize(pieces, "pieces")
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))

    import numpy as np

    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in found.collect():  # a row per length: at most ``capacity``
        counts[row["length"]] = row["n"]
    if not counts.any():
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    first, sequences, offsets = runs_of_plan(plan_packing(counts, capacity))

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(rank):
        import numpy as np
        import pandas as pd

        ranks = rank.to_numpy()
        run = np.searchsorted(first, ranks, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[run] + ranks - first[run], "offset": offsets[run]})

    ranked, _ = common.with_rank(pieces, ["length", "doc_id", "piece", "start"], "rank", "piece-order")
    placed = ranked.withColumn("place", place("rank"))
    return placed.select(*pieces.columns, "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary): the pieces of a sequence (with their ids) joined in place."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def packed_documents(docs: DataFrame, path: str | None = None, cache_words: int = 600_000) -> DataFrame:
    return pack(token_pieces(docs, path or tokenizer_path(), cache_words=cache_words))


def op8_pattern_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(common.table(spark, sf, "documents"))
