"""Block-wise joins: every pair of a left and a right row meets in exactly one cell.

Both sides are hashed on their keys into blocks of a bounded byte size.  A cell
is one left block next to one right block; Spark shuffles each side to the cells
that need it and one task works through a cell with NumPy.  Pairs never leave a
cell: only its best hits, or its partial sums, do.

A search of a right side of more than one block copies neither side: the left side is written in groups, and the
task of a group reads the stored right side batch by batch (:func:`beside_all`), holding its best hits so far.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsight.storage import fresh_path, materialize

# Bytes of one side of a cell; a Python worker takes several times that, for rows, sorted rows, numbers and hits.
BLOCK_BYTES = 32 * 1024 * 1024
# Bytes of one hit.
HIT_BYTES = 32
# Most bytes of left vectors that are sent to the tasks of the right side, and of hits that such a task holds.
SEND_BYTES = 32 * 1024 * 1024
# Multiply-adds that justify a task of their own.
TASK_WORK = 2e8
# Up to this many cells each has a partition of its own; above, so many share one on average.
DIRECT_CELLS, CELLS_A_PARTITION = 20_000, 2
# Array elements of one scratch buffer inside a task.
SCRATCH = 4_000_000
# Rows and columns of the products that are looked at at once; fewer than two such widths of columns are multiplied in double precision.
TILE_ROWS, TILE_COLS = 256, 4096
# Least left rows of a group, unless their bytes ask for more groups, and groups that are searched in one job.
GROUP_ROWS, WAVE = 4096, 256
# Relative error of a number that is rounded to single precision, its least normal number, and the largest value used in it.
HALF_STEP, LEAST_NORMAL, LARGEST = 2.0**-24, 2.0**-126, 1e37


def blocks_for(rows: int, row_bytes: int) -> int:
    return max(1, math.ceil(rows * max(row_bytes, 1) / BLOCK_BYTES))


def left_blocks_for(rows: int, row_bytes: int, right_blocks: int, work: float, parallelism: int) -> int:
    """Left blocks that bound the bytes of a cell and, for enough work, keep all cores busy.

    Every further left block copies the right side once more, so cells are added
    only up to the number of cores.
    """
    tasks = min(parallelism, math.ceil(work / TASK_WORK))
    return max(blocks_for(rows, row_bytes), math.ceil(tasks / right_blocks))


def row_block(keys: Sequence[str], blocks: int):
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(blocks)).cast("int")


def cogroup_cells(
    left: DataFrame,
    right: DataFrame,
    left_block,
    right_block,
    left_blocks: int,
    right_blocks: int,
    function: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    replicate_left: bool = True,
) -> DataFrame:
    """Run ``function`` on every cell of the block grid.

    ``right`` is copied once per left block.  ``left`` is copied once per right
    block, unless its rows already belong to one right block (``left_block`` then
    is the pair of block columns).
    """
    cells = left_blocks * right_blocks
    every_right = F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1)))
    every_left = F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1)))
    if replicate_left:
        lhs = left.withColumn("_lb", left_block).withColumn("_rb", every_right)
    else:
        lhs = left.withColumn("_lb", left_block[0]).withColumn("_rb", left_block[1])
    rhs = right.withColumn("_rb", right_block).withColumn("_lb", every_left)
    cell = (F.col("_lb") * F.lit(right_blocks) + F.col("_rb")).cast("int")
    lhs = lhs.withColumn("_cell", cell).drop("_lb", "_rb")
    rhs = rhs.withColumn("_cell", cell).drop("_lb", "_rb")
    if cells <= DIRECT_CELLS:
        lhs, rhs = lhs.repartitionById(cells, "_cell"), rhs.repartitionById(cells, "_cell")
    else:
        lhs, rhs = (x.repartition(math.ceil(cells / CELLS_A_PARTITION), "_cell") for x in (lhs, rhs))
    return lhs.groupBy("_cell").cogroup(rhs.groupBy("_cell")).applyInArrow(function, schema)


def matrix(column, dtype=np.float64) -> np.ndarray:
    """An Arrow column of equally long lists as a 2-d array; nulls and unequal lengths raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0), dtype)
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("a vector is null or has a null in it")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors differ in width: {sizes.min()} to {sizes.max()}")
    flat = flat.to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1)


def list_array(rows: np.ndarray) -> pa.ListArray:
    """A 2-d array as an Arrow list column."""
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1)))


def group_count(rows: int, row_bytes: int, work: float, parallelism: int) -> int:
    """Groups of left rows that bound the bytes of a group and keep all cores busy, two turns each."""
    tasks = min(2 * parallelism, math.ceil(work / TASK_WORK), rows // GROUP_ROWS)
    return max(1, blocks_for(rows, row_bytes), tasks)


def beside_all(
    left: DataFrame, right: DataFrame, group, groups: int, task: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator], schema: str
) -> DataFrame:
    """``task`` over each group of left rows, as a table, and the batches of all right rows.

    The left side is written by group and ``right``, a written table, is read by the task of each group where it is:
    nothing of it is copied or shuffled.  Column names of the sides differ.
    """
    spark, path = left.sparkSession, fresh_path(left.sparkSession, "groups")
    parted = left.withColumn("_group", group)
    parted.repartition(groups, "_group").write.partitionBy("_group").parquet(path)
    stored = spark.read.schema(parted.schema).parquet(path)
    sizes = {r._group: r.n for r in stored.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).collect()}
    names, others = left.columns, right.columns
    rows = right.withColumn("_side", F.lit(1))

    def of_group(size: int) -> Callable:
        def run(stream):
            held, known, early, rest = [], 0, [], iter(stream)

            def split(batch):
                side = batch.column("_side").to_numpy()
                return batch.filter(pa.array(side == 0)).select(names), batch.filter(pa.array(side == 1)).select(others)

            # The group is read first, as a rule; what comes before its last row waits.
            for batch in rest:
                own, other = split(batch)
                held.append(own)
                known += own.num_rows
                if other.num_rows:
                    early.append(other)
                if known == size:
                    break

            def later():
                while early:
                    yield early.pop(0)
                for batch in rest:
                    if batch.num_rows:
                        yield batch.select(others)

            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            yield from task(table, later())

        return run

    # Spark would give a union of single partitions one partition again; one side without any keeps them apart.
    apart = stored.filter(F.col("_group") < 0).mapInArrow(lambda stream: iter(()), schema)
    found, wave = [], [apart]
    for number, (value, size) in enumerate(sorted(sizes.items()), 1):
        own = stored.filter(F.col("_group") == value).drop("_group").withColumn("_side", F.lit(0))
        # One partition without a shuffle: its task reads the files of both sides, one after the other.
        one = own.unionByName(rows, allowMissingColumns=True).coalesce(1)
        wave.append(one.mapInArrow(of_group(size), schema))
        if number % WAVE == 0 and number < len(sizes):
            # Plans stay of a bounded size.
            found.append(materialize(_union(wave), "hits"))
            wave = [apart]
    return _union([*found, *wave]) if sizes else spark.createDataFrame([], schema)


def _union(frames: list[DataFrame]) -> DataFrame:
    """All rows; a plan of little depth."""
    while len(frames) > 1:
        frames = [a.unionByName(b[0]) if b else a for a, *b in (frames[i : i + 2] for i in range(0, len(frames), 2))]
    return frames[0]


def slots_of(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, from 0, equal where all key columns are (nulls, too), and a row of each number."""
    codes = np.zeros(table.num_rows, np.int64)
    for name in names:
        encoded = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * max(len(encoded.dictionary), 1) + encoded.indices.to_numpy(), return_inverse=True)[1]
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return codes, first


def key_codes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """One number per row, equal where all key columns are equal."""
    codes = np.zeros(table.num_rows, np.int64)
    for name in names:
        encoded = table[name].combine_chunks().dictionary_encode()
        codes = codes * max(len(encoded.dictionary), 1) + encoded.indices.to_numpy()
    return codes


def exact_dots(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of chosen row pairs, summed strictly left to right.

    Unlike a matrix product, the result does not depend on the block layout.
    """
    out = np.empty(len(rows))
    step = max(1, SCRATCH // max(x.shape[1], 1))
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        products = x[rows[part]] * y[cols[part]]
        out[part] = np.add.accumulate(products, axis=1)[:, -1]
    return out


def best_of_rows(scores: np.ndarray, k: int, slack: np.ndarray | float = 0.0):
    """Row and column numbers of every entry that can be among the k best of its row.

    ``slack`` is how far an entry may be off; ties at the edge are all returned.
    """
    n, m = scores.shape
    if m <= k:
        return np.nonzero(scores > -np.inf)
    edge = np.partition(scores, m - k, axis=1)[:, m - k] - slack
    return np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))


def ranked(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int):
    """Order by row, best score, then column; keep k per row.  Returns order and ranks from 1."""
    order = np.lexsort((cols, -scores, rows))
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]]) if len(rows) else rows
    sizes = np.diff(np.r_[starts, len(rows)])
    rank = np.arange(len(rows)) - np.repeat(starts, sizes) + 1
    keep = rank <= k
    return order[keep], rank[keep]


def trimmed(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, k: int, slack: np.ndarray):
    """Candidates that are not below the k-th value of their row by more than its slack, and these k-th values."""
    order = np.lexsort((-values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    ends = np.searchsorted(rows, np.arange(n + 1))
    kth = np.full(n, -np.inf)
    full = np.flatnonzero(np.diff(ends) >= k)
    kth[full] = values[ends[full] + k - 1]
    keep = values >= kth[rows] - slack[rows]
    return rows[keep], cols[keep], values[keep], kth


def places_above(scores: np.ndarray, floor: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Flat places of the scores that are not below the floor of their row; ``hit`` is scratch."""
    hit = hit[: scores.size]
    np.greater_equal(scores, floor[:, None], out=hit.reshape(scores.shape))
    if len(hit) % 8:
        return np.flatnonzero(hit)
    # Few are: eight are looked at at once.
    some = np.flatnonzero(hit.view(np.uint64))
    which, place = np.nonzero(hit.reshape(-1, 8)[some])
    return some[which] * 8 + place


def single_floor(floor: np.ndarray) -> np.ndarray:
    """The largest numbers of single precision that are not above ``floor``, or the next below."""
    return np.nextafter(floor.astype(np.float32), np.float32(-np.inf))


def _single_candidates(x, tiles, biases, k: int, edge: np.ndarray, slack: np.ndarray, scratch, hit):
    """Rows and columns of the products that can be among the k best, chosen in single precision, tile by tile.

    ``slack`` is twice what a score may be off; what is below ``edge`` is no candidate.
    """
    n, x = len(x), x.astype(np.float32)
    floor, held, waiting = edge - slack, [], 0
    kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    for number, tile in enumerate(tiles):
        scores = np.matmul(x, tile, out=scratch[: n * tile.shape[1]].reshape(n, -1))
        if biases is not None:
            scores += biases[number]
        fresh = np.flatnonzero(np.isneginf(floor))
        if len(fresh) and scores.shape[1] >= k:
            edge_of = scores.shape[1] - k
            floor[fresh] = np.partition(scores[fresh], edge_of, axis=1)[:, edge_of] - slack[fresh]
        places = places_above(scores, single_floor(floor), hit)
        rows, cols = np.divmod(places, scores.shape[1])
        held.append((rows, cols + number * TILE_COLS, scores.reshape(-1)[places]))
        waiting += len(rows)
        if waiting > 4 * n * k or number == len(tiles) - 1:
            rows, cols, values = (np.concatenate(parts) for parts in zip(kept, *held))
            *kept, kth = trimmed(rows, cols, values.astype(np.float64), n, k, slack)
            floor, held, waiting = np.maximum(floor, kth - slack), [], 0
    return kept[:2]


def top_products(x: np.ndarray, y: np.ndarray, bias: np.ndarray | None, k: int, edge: np.ndarray | None = None):
    """Exact k best columns of ``x @ y.T + bias`` per row: rows, columns, scores, ranks.

    Rows and columns with a NaN or an infinity have no hits and are none.  Scores below the ``edge`` of their
    row are left out.
    """
    usable = np.isfinite(y).all(axis=1) if len(y) else np.empty(0, bool)
    if bias is not None:
        usable &= np.isfinite(bias)
    askable = np.isfinite(x).all(axis=1) if len(x) else np.empty(0, bool)
    if not (usable.all() and askable.all()):
        columns, queries = np.flatnonzero(usable), np.flatnonzero(askable)
        rows, cols, scores, ranks = top_products(
            x[queries], y[columns], None if bias is None else bias[columns], k, None if edge is None else edge[queries]
        )
        return queries[rows], columns[cols], scores, ranks
    found = []
    if len(x) and len(y):
        dim = x.shape[1]
        if dim != y.shape[1]:
            raise ValueError(f"vectors of width {dim} are compared with vectors of width {y.shape[1]}")
        longest = np.sqrt((y * y).sum(axis=1).max())
        bias_size = 0.0 if bias is None else np.abs(bias).max()
        norm = np.sqrt((x * x).sum(axis=1))
        edge = np.full(len(x), -np.inf) if edge is None else edge
        single = len(y) >= max(2 * TILE_COLS, 16 * k) and norm.max() * longest + norm.max() + longest + bias_size < LARGEST
        if single:
            # Single precision chooses what is summed exactly; its sums of d terms in any order are off by less than this.
            slack = 4.0 * (dim + 8) * HALF_STEP * (norm * longest + bias_size) + 4.0 * (dim + 1) * LEAST_NORMAL * (norm + longest + 1.0)
            starts = range(0, len(y), TILE_COLS)
            tiles = [np.ascontiguousarray(y[i : i + TILE_COLS].T, dtype=np.float32) for i in starts]
            biases = None if bias is None else [bias[i : i + TILE_COLS].astype(np.float32) for i in starts]
            scratch, hit = np.empty(TILE_ROWS * TILE_COLS, np.float32), np.empty(TILE_ROWS * TILE_COLS, bool)
        else:
            # In double precision they are off by less than half of this.
            slack = 8.0 * dim * np.finfo(np.float64).eps * (norm * longest + bias_size)
        step = TILE_ROWS if single else max(1, SCRATCH // len(y))
        for start in range(0, len(x), step):
            at = slice(start, start + step)
            part = x[at]
            if single:
                rows, cols = _single_candidates(part, tiles, biases, k, edge[at], slack[at], scratch, hit)
            else:
                scores = part @ y.T
                if bias is not None:
                    scores += bias
                rows, cols = best_of_rows(scores, k, slack[at])
            exact = exact_dots(part, y, rows, cols)
            if bias is not None:
                exact = exact + bias[cols]
            kept = exact >= edge[at][rows]
            rows, cols, exact = rows[kept], cols[kept], exact[kept]
            order, rank = ranked(rows, cols, exact, k)
            found.append((rows[order] + start, cols[order], exact[order], rank))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0), none
    return tuple(np.concatenate(parts) for parts in zip(*found))


class BestHits:
    """The k best hits so far of each of n rows, best first, ties by the smaller key.

    ``edge`` is the k-th best score of a row, minus infinity before it has k hits: what is below it is no hit.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.edge = np.full(n, -np.inf)
        self.table: pa.Table | None = None

    def add(self, rows: np.ndarray, scores: np.ndarray, **columns) -> None:
        """Takes new hits in (``key`` and any further columns); only rows that have some are sorted again."""
        kept = ~(scores < self.edge[rows])
        if not kept.any():
            return
        fresh = pa.table({"row": rows, "score": scores, **columns}).filter(pa.array(kept))
        rest = None
        if self.table is not None:
            touched = np.zeros(self.n, bool)
            touched[rows[kept]] = True
            mine = touched[self.table["row"].to_numpy()]
            rest = self.table.filter(pa.array(~mine))
            fresh = pa.concat_tables([self.table.filter(pa.array(mine)), fresh])
        fresh = fresh.sort_by([("row", "ascending"), ("score", "descending"), ("key", "ascending")])
        row = fresh["row"].to_numpy()
        place = np.arange(len(row)) - np.searchsorted(row, row)
        fresh = fresh.filter(pa.array(place < self.k))
        last = place == self.k - 1
        self.edge[row[last]] = fresh["score"].to_numpy()[place[place < self.k] == self.k - 1]
        self.table = fresh if rest is None or not rest.num_rows else pa.concat_tables([rest, fresh])


class WaitingHits:
    """:class:`BestHits` that are sorted only when half as many new ones wait as may be held."""

    def __init__(self, n: int, k: int):
        self.best, self.most = BestHits(n, k), n * k // 2
        self.waiting, self.n_waiting = [], 0

    @property
    def edge(self) -> np.ndarray:
        return self.best.edge

    def add(self, rows: np.ndarray, scores: np.ndarray, keys: pa.Array) -> None:
        if len(rows):
            self.waiting.append((rows, scores, keys))
            self.n_waiting += len(rows)
            if self.n_waiting >= self.most:
                self._sort()

    def _sort(self) -> None:
        if self.waiting:
            rows, scores, keys = zip(*self.waiting)
            keys = pa.concat_arrays([k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in keys])
            self.waiting, self.n_waiting = [], 0
            self.best.add(np.concatenate(rows), np.concatenate(scores), key=keys)

    def ranked(self) -> Iterator[pa.Table]:
        """All hits held: row, score, key, and their rank from 1; a piece at a time."""
        self._sort()
        held = self.best.table
        if held is not None:
            # Rows that were not touched by the last sort stand apart, each row's hits together and in order.
            row = held["row"].to_numpy()
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)])) + 1
            held = held.append_column("rank", pa.array(rank.astype(np.int32)))
            for start in range(0, held.num_rows, 65_536):
                yield held.slice(start, 65_536)


def vector_shape(df: DataFrame, column: str, what: str) -> tuple[int, int]:
    """Number of vectors and their width; raises on nulls and unequal widths."""
    size = F.size(F.col(column))
    rows, known, least, most = df.agg(
        F.count("*"), F.count(column), F.min(size), F.max(size)
    ).first()
    if rows != known:
        raise ValueError(f"{rows - known} {what} have no vector")
    if least != most:
        raise ValueError(f"vectors of {what} differ in width: {least} to {most}")
    return rows, most or 0


def inner_topk(
    left: DataFrame,
    right: DataFrame,
    k: int,
    left_keys: Sequence[str],
    right_key: str,
    left_vec: str,
    right_vec: str,
    bias: str | None = None,
    left_blocks: int | None = None,
    right_blocks: int | None = None,
) -> DataFrame:
    """The k right rows with the largest inner product (plus ``bias``) for each left row.

    Exact.  A left side of few bytes is sent to the tasks of the right side, which is not moved; a larger one is
    cut into groups whose tasks read the right side, unless that is one block; both meet in cells then, and
    always when numbers of blocks are given.  All give the same hits.
    Ties go to the smaller right key.  Vectors must be of one width and not null; one with
    a NaN or an infinity is never a hit and has none.  Returns the left keys, the right
    key, ``score`` and ``rank`` from 1; fewer than k rows when ``right`` is smaller.
    """
    spark = left.sparkSession
    left_keys = list(left_keys)
    chosen = left_blocks is not None or right_blocks is not None
    lhs = left.select(*left_keys, F.col(left_vec).alias("_x"))
    rhs = right.select(
        F.col(right_key).alias("_y_key"),
        F.col(right_vec).alias("_y"),
        *([F.col(bias).cast("double").alias("_y_bias")] if bias else []),
    )
    if left_blocks is None or right_blocks is None:
        n_left, left_dim = vector_shape(lhs, "_x", "queries")
        n_right, dim = vector_shape(rhs, "_y", "passages")
        if n_left and n_right and left_dim != dim:
            raise ValueError(f"queries of width {left_dim} are compared with passages of width {dim}")
        # A left row brings its vector and takes its hits.
        row_bytes = 8 * (dim or 1)
        left_bytes, work = max(row_bytes, HIT_BYTES * min(k, n_right)), float(n_left) * n_right * (dim or 1)
        parallelism = spark.sparkContext.defaultParallelism

    key_type = right.schema[right_key].dataType.simpleString()
    key_fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in lhs.select(*left_keys).schema]
    schema = ", ".join([*key_fields, f"`{right_key}` {key_type}", "score double", "rank int"])

    if not chosen:
        if n_left * left_bytes <= SEND_BYTES:
            return keep_best(_sent_topk(lhs, rhs, k, left_keys, right_key, bool(bias), schema), left_keys, right_key, k)
        if blocks_for(n_right, row_bytes) > 1:
            groups = group_count(n_left, left_bytes, work, parallelism)
            return _grouped_topk(lhs, materialize(rhs, "right"), k, left_keys, right_key, bool(bias), schema, groups)
    right_blocks = right_blocks or blocks_for(n_right, row_bytes)
    left_blocks = left_blocks or left_blocks_for(n_left, left_bytes, right_blocks, work, parallelism)

    def cell(lhs: pa.Table, rhs: pa.Table) -> pa.Table:
        rhs = rhs.sort_by("_y_key")
        y_bias = rhs["_y_bias"].to_numpy() if bias else None
        rows, cols, scores, ranks = top_products(matrix(lhs["_x"]), matrix(rhs["_y"]), y_bias, k)
        keys = lhs.select(left_keys).take(pa.array(rows))
        return pa.table(
            [*keys.columns, rhs["_y_key"].take(pa.array(cols)), pa.array(scores), pa.array(ranks.astype(np.int32))],
            names=[*left_keys, right_key, "score", "rank"],
        )

    hits = cogroup_cells(
        lhs,
        rhs,
        row_block(left_keys, left_blocks),
        row_block(["_y_key"], right_blocks),
        left_blocks,
        right_blocks,
        cell,
        schema,
    )
    return hits if right_blocks == 1 else keep_best(hits, left_keys, right_key, k)


def _sent_topk(
    lhs: DataFrame, rhs: DataFrame, k: int, left_keys: list[str], right_key: str, biased: bool, schema: str
) -> DataFrame:
    """Best hits of each left row within each task of the right side, which stays where it is.

    The left side has been checked to be small.  A task keeps k hits per left row.
    """
    table = lhs.toArrow()
    sent = lhs.sparkSession.sparkContext.broadcast((matrix(table["_x"]), table.select(left_keys)))

    def best(stream):
        x, keys = sent.value
        # Ranks are given when the tasks' hits are merged.
        yield from _best_of(x, keys, np.arange(len(x)), stream, k, left_keys, right_key, biased)

    return rhs.mapInArrow(best, schema)


def _grouped_topk(
    lhs: DataFrame, rhs: DataFrame, k: int, left_keys: list[str], right_key: str, biased: bool, schema: str, groups: int
) -> DataFrame:
    """Best hits of each left key; the task of a group of left rows reads the whole right side, a written table."""

    def task(table, stream):
        slots, first = slots_of(table, left_keys)
        yield from _best_of(matrix(table["_x"]), table.select(left_keys).take(pa.array(first)), slots, stream, k, left_keys, right_key, biased)

    return beside_all(lhs, rhs, row_block(left_keys, groups), groups, task, schema)


def _best_of(x, keys: pa.Table, slots: np.ndarray, stream, k: int, left_keys: list[str], right_key: str, biased: bool):
    """The k best right rows of a stream for each slot, which is one or more rows of ``x`` with one key."""
    held = WaitingHits(keys.num_rows, k)
    for batch in stream:
        if batch.num_rows:
            part = pa.Table.from_batches([batch]).sort_by("_y_key")
            y_bias = part["_y_bias"].to_numpy() if biased else None
            rows, cols, scores, _ = top_products(x, matrix(part["_y"]), y_bias, k, held.edge[slots])
            held.add(slots[rows], scores, part["_y_key"].take(pa.array(cols)))
    for found in held.ranked():
        columns = [*keys.take(found["row"]).columns, found["key"], found["score"], found["rank"]]
        yield from pa.table(columns, names=[*left_keys, right_key, "score", "rank"]).to_batches()


def keep_best(hits: DataFrame, keys: Sequence[str], item: str, k: int) -> DataFrame:
    """Rank hits of each key by score, then item; keep the first k."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(item).asc())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
