"""A stored dense index: parts of clustered blocks that are only ever added, and exact search that skips blocks.

Adding vectors writes one part.  Its vectors are dealt to the nearest of some of their number and cut into
blocks; a block keeps its centre and radius, so q·x is at most q·centre + |q|·radius for all its vectors.  A
search sends the queries to the blocks, and a block whose bound is below the k-th best score of a query is
not multiplied with it.  A row of the manifest names the parts of a version; row numbers go on by the sizes
of the parts before.  A search pins a version, so it is not disturbed by what is added later.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparsight.operators.blocks import HIT_BYTES, SEND_BYTES, BestHits, keep_best, matrix, top_products, vector_shape
from sparsight.storage import materialize

# Vectors of a block, and most centres of a part: a bounded sample of its vectors, sent to all tasks.
BLOCK_ROWS, MOST_CENTRES = 2048, 1024
_MANIFEST = "version bigint, dim int, parts array<struct<folder: string, first_row: bigint, rows: bigint>>"


def newest_version(spark: SparkSession, base: str, name: str, version: int | None = None) -> Row | None:
    """The newest version of an index, or the one asked for; None when there is none."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{base}/dense/{name}/manifest")
    except AnalysisException:
        return None
    if version is not None:
        rows = rows.filter(F.col("version") == version)
    return rows.orderBy(F.desc("version"), F.col("parts")[F.size("parts") - 1]["folder"]).first()


def _clustered(vectors: DataFrame, rows: int) -> DataFrame:
    """The vectors with the nearest centre and the distance from it; those with a NaN or an infinity have centre -1."""
    wanted = min(MOST_CENTRES, -(-rows // BLOCK_ROWS))
    usable = F.forall("vec", lambda x: ~(F.isnan(x) | (F.abs(x) == float("inf"))))
    sample = vectors.filter(usable).orderBy(F.xxhash64("row_idx"), "row_idx").limit(wanted).select("vec").toArrow()
    sent = vectors.sparkSession.sparkContext.broadcast(matrix(sample["vec"]))
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def place(stream):
        centres = sent.value
        half = (centres * centres).sum(axis=1) / 2 if len(centres) else np.empty(0)
        for batch in stream:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"))
            good = np.isfinite(x).all(axis=1)
            group, far = np.full(len(x), -1, np.int32), np.zeros(len(x))
            if good.any():
                group[good] = (x[good] @ centres.T - half).argmax(axis=1)
                far[good] = np.sqrt(((x[good] - centres[group[good]]) ** 2).sum(axis=1))
            columns = [pa.array(group), pa.array(far), batch.column("row_idx"), batch.column("pid"), batch.column("vec")]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "far", "row_idx", "pid", "vec"])

    schema = f"group int, far double, row_idx bigint, pid {types['pid']}, vec {types['vec']}"
    return vectors.mapInArrow(place, schema)


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows of blocks: neighbours of one centre, cut by distance, in each block by pid."""
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    names = f"centre array<double>, radius double, row_idxs array<bigint>, pids array<{types['pid']}>, vectors {types['vec']}"
    schema = to_arrow_schema(vectors.sparkSession.createDataFrame([], names).schema)
    order = ["group", "far", "row_idx"]
    dealt = _clustered(vectors, rows).repartitionByRange(*order).sortWithinPartitions(*order)

    def block(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by("pid").combine_chunks()
        x = matrix(table["vec"])
        centre = x.mean(axis=0)
        good = np.isfinite(x).all()
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) if good else float("inf")
        one = lambda inner, field: pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner.cast(field.type.value_type))
        flat = table["vec"].combine_chunks()
        flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten()
        whole = lambda c: table[c].chunk(0) if isinstance(table[c], pa.ChunkedArray) else table[c]
        columns = [
            one(pa.array(centre if good else np.zeros(x.shape[1])), schema.field("centre")), pa.array([radius]),
            one(whole("row_idx"), schema.field("row_idxs")), one(whole("pid"), schema.field("pids")), one(flat, schema.field("vectors")),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def cut(stream):
        held, size, last = [], 0, None
        for batch in stream:
            table = pa.Table.from_batches([batch])
            group = batch.column("group").to_numpy()
            edges = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)] if len(group) else [0]
            for start, stop in zip(edges[:-1], edges[1:]):
                if held and group[start] != last:
                    yield block(pa.concat_tables(held))
                    held, size = [], 0
                last = group[start]
                while start < stop:
                    n = min(stop - start, BLOCK_ROWS - size)
                    held.append(table.slice(start, n))
                    start, size = start + n, size + n
                    if size == BLOCK_ROWS:
                        yield block(pa.concat_tables(held))
                        held, size = [], 0
        if held:
            yield block(pa.concat_tables(held))

    return dealt.mapInArrow(cut, names)


def add(spark: SparkSession, base: str, name: str, vectors: DataFrame) -> int:
    """Adds vectors (row_idx from 0, pid, vec) as a part of the index, which is begun if there is none; its new version.

    Row numbers go on after those of the parts before.  Vectors must be of one width, that of the index.
    """
    newest = newest_version(spark, base, name)
    vectors = materialize(vectors.select(F.col("row_idx").cast("bigint").alias("row_idx"), "pid", "vec"), "added")
    rows, dim = vector_shape(vectors, "vec", "passages")
    if newest is not None and rows and newest.dim and newest.dim != dim:
        raise ValueError(f"vectors of width {dim} are added to an index of width {newest.dim}")
    version = newest.version + 1 if newest is not None else 0
    parts = [tuple(p) for p in newest.parts] if newest is not None else []
    folder = f"{base}/dense/{name}/parts/{version:06d}-{uuid.uuid4().hex[:12]}"
    _blocks(vectors, rows).write.parquet(folder)
    first = parts[-1][1] + parts[-1][2] if parts else 0
    row = (version, dim or (newest.dim if newest is not None else 0), [*parts, (folder, first, rows)])
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{base}/dense/{name}/manifest")
    return version


def _parts(spark: SparkSession, base: str, name: str, version: int | None) -> DataFrame:
    found = newest_version(spark, base, name, version)
    if found is None:
        raise ValueError(f"there is no index {name}" + (f" of version {version}" if version is not None else ""))
    frames = [spark.read.parquet(p.folder).withColumn("first_row", F.lit(p.first_row)) for p in found.parts]
    blocks = frames[0]
    for frame in frames[1:]:
        blocks = blocks.unionByName(frame)
    return blocks


def open_vectors(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    """row_idx, pid, vec of a version of the index."""
    blocks = _parts(spark, base, name, version)
    dim = F.size("centre")
    rows = blocks.select(
        "first_row", "vectors", dim.alias("dim"), F.posexplode(F.arrays_zip("row_idxs", "pids")).alias("place", "row")
    )
    vec = F.slice("vectors", F.col("place") * F.col("dim") + 1, F.col("dim"))
    return rows.select((F.col("first_row") + F.col("row.row_idxs")).alias("row_idx"), F.col("row.pids").alias("pid"), vec.alias("vec"))


def search(
    spark: SparkSession, base: str, name: str, queries: DataFrame, k: int, version: int | None = None, report: bool = False
) -> DataFrame:
    """The k passages of a version with the largest inner product per query (``qid, vec``): qid, row_idx, pid, score, rank.

    Exact, with the hits of ``dense_topk``.  Queries are sent in parts that, with their hits, are of bounded size; blocks stay.
    With ``report``, instead the products of a query and a passage there are, and those that were made.
    """
    blocks = _parts(spark, base, name, version)
    queries = materialize(queries.select("qid", "vec"), "asked")
    number, dim = vector_shape(queries, "vec", "queries")
    parts = max(1, -(-number * (8 * dim + HIT_BYTES * k) // SEND_BYTES))
    found = None
    for i in range(parts):
        part = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)
        hits = _search_part(blocks, part, k, report)
        found = hits if found is None else found.unionByName(hits)
    return found if report else keep_best(found, ["qid"], "pid", k)


def _search_part(blocks: DataFrame, queries: DataFrame, k: int, report: bool) -> DataFrame:
    table = queries.toArrow()
    sent = blocks.sparkSession.sparkContext.broadcast((table["qid"].combine_chunks(), matrix(table["vec"]) if table.num_rows else np.empty((0, 0))))
    pid = blocks.schema["pids"].dataType.elementType.simpleString()
    names = f"qid {queries.schema['qid'].dataType.simpleString()}, row_idx bigint, pid {pid}, score double"

    def task(stream):
        qids, x = sent.value
        best, there, made = BestHits(len(x), k), 0, 0
        long = np.sqrt((x * x).sum(axis=1)) if len(x) else np.empty(0)
        for batch in stream:
            if not batch.num_rows or not len(x):
                continue
            centres, radius = matrix(batch.column("centre")), batch.column("radius").to_numpy()
            if centres.shape[1] != x.shape[1]:
                raise ValueError(f"queries of width {x.shape[1]} are compared with passages of width {centres.shape[1]}")
            with np.errstate(invalid="ignore", over="ignore"):
                reach = np.sqrt((centres * centres).sum(axis=1)) + radius
                bound = x @ centres.T + long[:, None] * radius
                # Products and the bound itself are rounded.
                bound += 8.0 * (x.shape[1] + 4) * np.finfo(np.float64).eps * long[:, None] * reach
                order = np.argsort(-np.nan_to_num(bound, posinf=0.0, neginf=0.0, nan=0.0).mean(axis=0))
            for i in order.tolist():
                pids = batch.column("pids")[i].values
                y = batch.column("vectors")[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(pids), -1)
                asked = np.flatnonzero(~(bound[:, i] < best.edge))
                there += len(x) * len(y)
                made += len(asked) * len(y)
                if not len(asked):
                    continue
                rows, cols, scores, _ = top_products(x[asked], y, None, k)
                place = batch.column("row_idxs")[i].values.to_numpy(zero_copy_only=False)[cols] + batch.column("first_row")[i].as_py()
                best.add(asked[rows], scores, key=pids.take(pa.array(cols)), row_idx=place)
        if report:
            yield pa.RecordBatch.from_arrays([pa.array([there]), pa.array([made])], names=["there", "made"])
        elif best.table is not None:
            t = best.table
            columns = [qids.take(t["row"].combine_chunks()), t["row_idx"], t["key"], t["score"]]
            yield from pa.table(columns, names=["qid", "row_idx", "pid", "score"]).to_batches(max_chunksize=65_536)

    return blocks.mapInArrow(task, "there bigint, made bigint" if report else names)


def skipped_share(spark: SparkSession, base: str, name: str, queries: DataFrame, k: int) -> float:
    """The share of products of a query and a passage that a search does not make."""
    there, made = search(spark, base, name, queries, k, report=True).agg(F.sum("there"), F.sum("made")).first()
    return 1.0 - made / there if there else 0.0
