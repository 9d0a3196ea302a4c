"""NumPy array shards: ``00000000.npy``, ``00000001.npy``, … float32, one row per vector.

Row i lives in shard ``i mod n`` at offset ``i div n``.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsight.functions.columns import offset_of, row_of, shard_of
from sparsight.operators.blocks import list_array, matrix

# Rows read by one task step.
ROWS_PER_RANGE = 8_192
# Fixed value: no array header of this format version is longer.
MAX_HEADER = 65_536 + 10


def _open(path: str):
    """File system and inner path of a path as Hadoop prints it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    elif path.startswith("/"):
        path = f"file://{path}"
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _header(stream) -> tuple[tuple[int, ...], np.dtype, int]:
    head = io.BytesIO(stream.read_at(min(MAX_HEADER, stream.size()), 0))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(head)
    if fortran or len(shape) != 2:
        raise ValueError("vector shards are row-major arrays of two dimensions")
    return shape, dtype, head.tell()


def import_vector_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``row_idx, vec`` from all array shards of a folder, in sorted file-name order.

    Files are listed without their content; headers and row ranges are read by tasks.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path")
    )
    order = Window.orderBy("path")
    numbered = files.withColumn("shard", F.row_number().over(order) - 1)
    shards = numbered.count()

    def read_headers(stream):
        for batch in stream:
            rows = []
            for path in batch.column("path").to_pylist():
                filesystem, inner = _open(path)
                with filesystem.open_input_file(inner) as file:
                    rows.append(_header(file)[0][0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("shard"), pa.array(rows, pa.int64())],
                names=["path", "shard", "rows"],
            )

    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, F.lit(ROWS_PER_RANGE).cast("bigint")))
    ranges = (
        numbered.repartition(max(1, min(shards, 1000)), "path")
        .mapInArrow(read_headers, "path string, shard int, rows bigint")
        .filter("rows > 0")
        .select("path", "shard", "rows", starts.alias("start"))
        .repartition("path", "start")
    )

    def read_ranges(stream):
        for batch in stream:
            for row in batch.to_pylist():
                filesystem, inner = _open(row["path"])
                with filesystem.open_input_file(inner) as file:
                    (_, width), dtype, begin = _header(file)
                    count = min(ROWS_PER_RANGE, row["rows"] - row["start"])
                    line = width * dtype.itemsize
                    data = file.read_at(count * line, begin + row["start"] * line)
                values = np.frombuffer(data, dtype).reshape(count, width).astype(np.float32)
                offset = row["start"] + np.arange(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(count, row["shard"], np.int32)), pa.array(offset), list_array(values)],
                    names=["shard", "off", "vec"],
                )

    vectors = ranges.mapInArrow(read_ranges, "shard int, off bigint, vec array<float>")
    return vectors.select(row_of("shard", "off", shards).alias("row_idx"), "vec")


def export_vector_shards(vectors: DataFrame, shards: int, folder: str) -> DataFrame:
    """Write ``row_idx, vec`` (dense from 0) as ``shards`` array files; returns file and row counts.

    Each shard is streamed by one task in row order, batch by batch.
    """
    total = vectors.count()
    placed = vectors.select(
        shard_of("row_idx", shards).alias("shard"),
        offset_of("row_idx", shards).alias("off"),
        F.col("vec").cast("array<float>").alias("vec"),
    )
    ordered = placed.repartitionById(shards, "shard").sortWithinPartitions("shard", "off")

    def write(stream):
        filesystem, inner = _open(folder)
        filesystem.create_dir(inner, recursive=True)
        sink, shard, attempt, rows = None, None, None, 0
        for batch in stream:
            if batch.num_rows == 0:
                continue
            values = matrix(batch.column("vec"), np.float32)
            if sink is None:
                shard = batch.column("shard")[0].as_py()
                head = io.BytesIO()
                shape = ((total - shard + shards - 1) // shards, values.shape[1])
                np.lib.format.write_array_header_1_0(
                    head, {"descr": "<f4", "fortran_order": False, "shape": shape}
                )
                # Another attempt of this task writes elsewhere; the last move wins, whole.
                attempt = f"{inner}/_{shard:08d}.{TaskContext.get().taskAttemptId()}"
                sink = filesystem.open_output_stream(attempt)
                sink.write(head.getvalue())
            places = batch.column("off").to_numpy()
            if (places != np.arange(rows, rows + len(values))).any():
                raise ValueError(f"the rows of shard {shard} are not numbered from 0 without gaps")
            sink.write(values.astype("<f4").tobytes())
            rows += len(values)
        if sink is not None:
            sink.close()
            if rows != shape[0]:
                raise ValueError(f"shard {shard} has {rows} rows, its header says {shape[0]}")
            filesystem.move(attempt, f"{inner}/{shard:08d}.npy")
            yield pa.RecordBatch.from_pydict({"file": [f"{shard:08d}.npy"], "rows": [rows]})

    return ordered.mapInArrow(write, "file string, rows bigint")
