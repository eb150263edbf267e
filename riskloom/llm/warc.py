"""Operator 8: WARC records in seekable Zstandard bundles.

Records are grouped into frames that are compressed on their own; a bundle is a row of frames and a
seek table in a skippable frame at its end (magic 0x8F92EAB1, one entry of two little-endian 32-bit
sizes for each frame).  The index maps a record's id to its bundle, frame and offset within the
decompressed frame, so one record is read by decompressing one frame.

A payload of at least `least` bytes that several rows share is written once, as the response of the
largest id; the other rows become revisit records that name it.

Bundles are files in the shared folder.  A task writes under a name of its own attempt and renames
when complete; the index, which is the table of what tasks returned, names exactly one attempt's
file for each task that counted, so a lost or repeated task leaves no wrong row.

Null html is an empty payload.  Null ids are written without the id's header and are the smallest of
their group.  Rows that repeat an id and payload are all responses if that id is the largest.  Null
urls are written as an empty target.
"""

from __future__ import annotations

import base64
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches, local_path, new_folder, saved, table

LEAST = 1000
#: Bytes of records in a frame, and of compressed frames in a bundle, about.
FRAME, BUNDLE = 256 << 10, 24 << 20
#: Fixed: the seekable format's numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit has no payload, but its length and digest in the headers."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of the records of a decompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in frame[at:end].decode().split("\r\n")[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield at, head, frame[start:stop]
        at = stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame at a bundle's end: compressed and decompressed sizes of its frames."""
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of a bundle's frames, from its seek table."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    entries, out, at = bundle[-9 - n * width : -9], [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", entries, i * width)
        out.append((at, c, d))
        at += c
    return out


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its frame and offset; no other frame is decompressed."""
    at, size, plain = frames(bundle)[frame]
    data = zstandard.ZstdDecompressor().decompress(bundle[at : at + size], max_output_size=plain)
    _, head, payload = next(records(data[offset:]))
    return head, payload


def _store(folder: str, name: str, parts: list[bytes]) -> str:
    """Writes a file whole or not at all; returns its URL."""
    path = local_path(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/.{name}", "wb") as f:
            for part in parts:
                f.write(part)
            f.flush()
            os.fsync(f.fileno())
        os.rename(f"{path}/.{name}", f"{path}/{name}")
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/.{name}") as f:
            for part in parts:
                f.write(part)
        store.move(f"{at}/.{name}", f"{at}/{name}")
    return f"{folder}/{name}"


def write_bundles(pages: DataFrame, folder: str, least: int = LEAST, id_: str = "page_id", url: str = "url", html: str = "html", frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Writes the records of pages and returns the index: id_, bundle (file), frame, offset, size."""
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit(""))
    kind = pages.schema[id_].dataType.simpleString()
    rows = pages.select(F.col(id_).alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    # Groups are counted over digests and ids only; the payloads are moved once, by digest.
    slim = pages.select(F.col(id_).alias("id"), F.sha1(payload.cast("binary")).alias("d"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    shared = slim.groupBy("d", "n").agg(F.max("id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    told = rows.join(shared, (F.col("digest") == F.col("d")) & (F.octet_length("payload") == F.col("n")), "left").drop("d", "n")
    told = told.withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")))
    # What a revisit leaves out needn't travel on.
    told = told.withColumns({"length": F.octet_length("payload"), "payload": F.when(~F.col("revisit"), F.col("payload")).otherwise(F.lit("")), "first": F.when(F.col("revisit"), F.col("first"))})

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        index: list[tuple] = []
        parts: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        now: list[bytes] = []
        begun = 0

        def close_frame() -> None:
            nonlocal now, begun
            if now:
                data = b"".join(now)
                parts.append(pack.compress(data))
                sizes.append((len(parts[-1]), len(data)))
            now, begun = [], 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal index, parts, sizes
            close_frame()
            place = _store(folder, f"{uuid.uuid4().hex}.warc.zst", [*parts, seek_table(sizes)])
            ids, frame_no, offset, size = zip(*index, strict=True)
            index, parts, sizes = [], [], []
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([place] * len(ids)), pa.array(frame_no, pa.int32()), pa.array(offset, pa.int64()), pa.array(size, pa.int64())], names=["id", "bundle", "frame", "offset", "size"])

        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field("id").type
            for r in batch.to_pylist():
                body = r["payload"].encode("utf-8", "surrogatepass")
                data = _headed(r, body)
                index.append((r["id"], len(sizes), begun, len(data)))
                now.append(data)
                begun += len(data)
                if begun >= frame:
                    close_frame()
                    if sum(c for c, _ in sizes) >= bundle:
                        yield close_bundle()
        if index:
            yield close_bundle()

    return saved(told.mapInArrow(written, f"id {kind}, bundle string, frame int, offset long, size long")).withColumnRenamed("id", id_)


def _headed(r: dict, body: bytes) -> bytes:
    data = record(r["id"], r["url"], body, r["digest"], r["first"], r["revisit"])
    return data.replace(b"X-Payload-Length: 0\r\n", b"X-Payload-Length: %d\r\n" % r["length"], 1) if r["revisit"] else data


def read_bundles(spark: SparkSession, files: list[str] | str, id_: str = "page_id", kind: str = "long") -> DataFrame:
    """What the archives hold: id_, payload_bytes, payload_digest, record_type, refers_to, url, payload,
    bundle, frame and offset.  Of a response the first two are computed from the payload read.

    kind: the type of the ids, long or string.
    """
    import hashlib

    bounded_batches(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(files).select("path", "content")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_, "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "bundle", "frame", "offset"]
        own, of = (pa.int64(), int) if kind == "long" else (pa.string(), str)
        kinds = [own, pa.int64(), pa.string(), pa.string(), own, pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                content = content.as_buffer().to_pybytes()
                unpack = zstandard.ZstdDecompressor()
                for number, (at, size, plain) in enumerate(frames(content)):
                    out = []
                    for offset, head, payload in records(unpack.decompress(content[at : at + size], max_output_size=plain)):
                        revisit = head["WARC-Type"] == "revisit"
                        told = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                        digest = told if revisit else hashlib.sha1(payload).hexdigest()
                        if digest != told:
                            raise ValueError(f"damaged record in {path}, frame {number}")
                        page, first = head.get("X-Page-ID"), head.get("X-Refers-To-Page") if revisit else None
                        length = int(head["X-Payload-Length"]) if revisit else len(payload)
                        out.append((of(page) if page is not None else None, length, digest, head["WARC-Type"], of(first) if first is not None else None, head["WARC-Target-URI"], payload, path, number, offset))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return found.mapInArrow(parsed, f"`{id_}` {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, url string, payload binary, bundle string, frame int, offset long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    index = write_bundles(table(spark, sf_dir, "pages"), folder)
    files = index.select("bundle").distinct()
    if index.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    # Files of attempts that didn't count aren't in the index.
    read = read_bundles(spark, folder).withColumn("name", F.substring_index("bundle", "/", -1))
    counted = files.select(F.substring_index("bundle", "/", -1).alias("name"))
    return read.join(counted, "name", "left_semi").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to FROM k
"""
