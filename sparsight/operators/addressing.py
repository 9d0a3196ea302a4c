"""Row numbers, id lookups and batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsight.functions.permutation import permuted
from sparsight.operators.skew import split_join
from sparsight.storage import materialize


def _numbered(rows: DataFrame, pieces: list[str], column: str) -> DataFrame | None:
    """Dense index from the place ``_pos`` in each file (or piece of a file); None if places have gaps.

    Pieces follow each other by folder, part number and name.  One summary row per piece is
    ordered in one place.
    """
    counts = rows.groupBy(*pieces).agg(
        F.count("*").alias("_rows"), F.min("_pos").alias("_first"), F.max("_pos").alias("_last")
    )
    counts = materialize(counts, "files")
    if not counts.filter("_last - _first + 1 <> _rows").isEmpty():
        return None
    # Spark numbers the files it writes without a fixed width beyond part-99999.
    folder = F.regexp_extract("_file", r"^(.*)/[^/]*$", 1)
    number = F.regexp_extract("_file", r"/part-([0-9]+)[^/]*$", 1).try_cast("bigint")
    before = Window.orderBy(folder, number, *pieces).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*pieces, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    index = F.col("_before") + F.col("_pos") - F.col("_first")
    return rows.join(starts, pieces).withColumn(column, index).drop(*pieces, "_pos", "_first", "_before")


def with_row_index(scan: DataFrame, column: str = "row_idx") -> DataFrame:
    """Dense 0-based index in source order: sorted file name, then place in the file.

    Names of files that Spark wrote are compared by their part number.  ``scan`` must read
    files.  For whole parquet files the place is the row number that the reader knows, so
    neither the data nor the index depends on how files are cut into tasks; one extra pass
    over the metadata columns counts the rows of each file.  Rows of other formats, or what
    a filter has left, are written once with their place in the split they came from, and
    numbered from that table.
    """
    meta = F.col("_metadata")
    file = meta["file_path"].alias("_file")
    try:
        placed = scan.select("*", file, meta["row_index"].alias("_pos"))
    except AnalysisException:
        placed = None
    found = _numbered(placed, ["_file"], column) if placed is not None else None
    if found is None:
        start, turn = meta["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_pos")
        found = _numbered(materialize(scan.select("*", file, start, turn), "lines"), ["_file", "_start"], column)
    return found


def with_ordered_index(df: DataFrame, order: list, column: str = "row_idx") -> DataFrame:
    """Dense 0-based index by a sort order.

    The sorted table is written once (range partitions, one file each), so the
    file order is the sort order and numbering needs no single-task window.
    """
    ordered = df.orderBy(*order)
    return with_row_index(materialize(ordered, "ordered"), column)


def lookup_ids(hits: DataFrame, table: DataFrame, position: str, key: str) -> DataFrame:
    """Replace the row number ``position`` of each hit by the ``key`` of that row in ``table``; hub rows are split."""
    names = table.select(F.col("row_idx").alias(position), key)
    return split_join(hits, names, [position]).drop(position)


def zip_ids_vectors(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows of both tables with the same ``row_idx``; stops at the shorter table."""
    return ids.join(vectors, "row_idx")


def assign_batches(
    df: DataFrame, size: int, shuffle: bool = False, seed: int = 0, position: str = "row_idx"
) -> DataFrame:
    """Consecutive batches of ``size`` rows by ``position``; the last may be short.

    With ``shuffle`` a row's place is first permuted by a keyed permutation of the positions, which must
    then be 0, 1, …; no row moves, and a row's batch can be told from its number alone.
    """
    place = F.col(position)
    if shuffle:
        rows, least, most = df.agg(F.count(position), F.min(position), F.max(position)).first()
        if rows and (least != 0 or most != rows - 1):
            raise ValueError(f"{rows} rows have positions from {least} to {most}: number them before shuffling")
        place = permuted(place, rows, seed)
    return df.withColumn("batch_id", F.call_function("div", place, F.lit(size)).cast("bigint"))


def head_batch(df: DataFrame, n: int, position: str = "row_idx") -> DataFrame:
    """The first ``n`` rows by position."""
    return df.orderBy(position).limit(n)


def prefix_neighbors(neighbors: DataFrame, k: int) -> DataFrame:
    """The first k neighbours of each query."""
    return neighbors.filter(F.col("rank") <= k)
