"""WARC archives: written by tasks, read back by splits.

Writing: SHA-1 digests are grouped (with partial aggregation, so that a payload a third of all pages
share is no hot group) and the record with the largest page_id of a repeated payload becomes its
response; the others point to it.  Each task writes its records, one gzip member each, to files of
its own attempt; only files in the committed manifest count, so that a repeated task leaves no trace.

Reading: a task gets a byte range, looks for the gzip magic in it, accepts a member if its first bytes
decode to a WARC header, and owns the records that start inside its range, reading past its end where
the last one goes on.  Checksums of members and payload digests are verified; a damaged record raises.

The folder must be reachable by ``pyarrow.fs`` from all executors (local or mounted, HDFS, S3).

Defined results: a null html is an empty payload; a null url writes no target; a null page_id is
always a response; repeated rows of one page write a record each, all of the same kind; an empty table
writes no records and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.storage import fresh_path, materialize

MIN_REVISIT_BYTES = 1000
FILE_BYTES, SPLIT_BYTES, READ_BYTES = 1 << 30, 16 << 20, 1 << 20
# First bytes of a member that are fed to its decoder.
FEED_BYTES = 4096
GZIP_LEVEL = 4
MAGIC = b"\x1f\x8b\x08"
#: Fixed by the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
#: The table has no capture times.
DATE = "1970-01-01T00:00:00Z"


# --- one record -------------------------------------------------------------


def record_bytes(page_id, url: str | None, payload: bytes, sha1_hex: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def page_of(record_id: str | None) -> str | None:
    """The page id in a record id."""
    return (record_id or "").strip("<>").removeprefix(RECORD_ID) or None


def parse_record(data: bytes) -> dict:
    """Fields of a record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = header_fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return {
        "page": page_of(fields["warc-record-id"]), "kind": kind, "digest": digest, "payload": payload,
        "bytes": int(header_fields(http)["content-length"]), "url": fields.get("warc-target-uri"),
        "refers_to": page_of(fields.get("warc-refers-to")),
    }


def owned_records(source, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start in ``[start, end)`` of an open file.

    What is read is kept once and looked at by position: a member is fed to the decoder in pieces that start
    small and double, so that the bytes copied follow the bytes of the members, and of a member known to be a
    record only what is not yet decoded is kept.
    """
    source.seek(start)
    held, base = b"", start

    def more(kept_from: int) -> bool:
        nonlocal held, base
        read = source.read(READ_BYTES)
        held, base = held[kept_from - base :] + read, kept_from
        return bool(read)

    at = start
    while at < end:
        found = held.find(MAGIC, at - base)
        if found < 0:  # keep two bytes: the magic may cross a border
            at = max(at, base + len(held) - 2)
            if at >= end or not more(at):
                return
            continue
        at = base + found
        if at >= end:
            return
        unpacker, parts, fed, known = zlib.decompressobj(31), [], at, False
        first, size = b"", FEED_BYTES
        while not unpacker.eof:
            if fed == base + len(held) and not more(fed if known else at):
                if known:
                    raise EOFError(f"record at byte {at} is cut off")
                break
            piece = held[fed - base : fed - base + size]
            try:
                part = unpacker.decompress(piece)
            except zlib.error:
                if known:
                    raise
                break
            fed += len(piece)
            size = min(2 * size, READ_BYTES)
            parts.append(part)
            if not known:
                first += part[:16]
                known = first.startswith(b"WARC/1.")
                if not known and len(first) >= 7:
                    break
        if known and unpacker.eof:
            yield b"".join(parts)
            at = fed - len(unpacker.unused_data)
        else:
            at += 1


# --- tables -----------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response)."""
    rows = pages.select("page_id", "url", common.text_bytes(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_ones = rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    ids = materialize(long_ones, "digests")
    newest = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    older = ids.join(newest.drop("n"), "digest").filter(F.col("page_id") < F.col("refers_to")).distinct()
    return rows.join(materialize(older, "revisits"), ["page_id", "digest"], "left")


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records; the manifest: file, bytes, records."""

    def write(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow import fs as filesystems
        from pyspark import TaskContext

        store, root = filesystems.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context, out, name, size, count = TaskContext.get(), None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    name = f"{context.partitionId():06d}-{len(done):03d}-{uuid.uuid4().hex[:12]}.warc.gz"
                    out, size, count = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = member(record_bytes(page, url, payload, digest, refers))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((name, size, count))
        if out is not None:
            out.close()
            done.append((name, size, count))
        columns = list(zip(*done)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["file", "bytes", "records"]
        )

    plain = records.select("page_id", "url", "payload", "digest", "refers_to")
    files = plain.mapInArrow(write, "file string, bytes bigint, records bigint")
    return materialize(files.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), "file")), "warc-manifest")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes of the archives in a folder that others wrote."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """page, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.select("file", F.explode(starts).alias("start"), "bytes")
    ranges = ranges.select("file", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    keys = ["page", "url", "bytes", "digest", "kind", "refers_to"]
    schema = "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    if with_payload:
        names, keys, schema = [*names, "payload"], [*keys, "payload"], schema + ", payload binary"

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs as filesystems

        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def batch_of(rows: list[dict]):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(keys, types)], names=names)

        for batch in batches:
            for file, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                store, path = filesystems.FileSystem.from_uri(file)
                with store.open_input_file(path) as source:
                    rows, held = [], 0
                    for data in owned_records(source, start, end):
                        rows.append(parse_record(data))
                        held += len(data) if with_payload else 100
                        if held > READ_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    tasks = common.pieces(files.agg(F.sum("bytes")).first()[0] or 0, split_bytes)
    return ranges.repartition(tasks).mapInArrow(read, schema)


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = common.table(spark, sf, "pages")
    key = pages.schema["page_id"].dataType
    manifest = write_warc(with_revisits(pages), fresh_path(spark, "warc"))
    read = read_warc(manifest)
    return read.select(
        F.col("page").cast(key).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(key).alias("refers_to"),
    )


OP4_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS last FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id < last THEN last END AS refers_to
FROM m
"""
