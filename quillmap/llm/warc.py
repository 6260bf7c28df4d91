"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with the records of
about ``frame_bytes``, and a skippable frame at its end: the seek table of the
Zstandard seekable format. An index maps record identifiers to a frame and an
offset in the decompressed frame, so that one record costs the footer and one
frame to read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, text_or_empty, written

# Fixed values of the seekable format and of the revisit profile.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SPACE = uuid.UUID("6f1c5a6e-6c1b-5b0e-9d8e-0a7c3c1f2b44")
DATE = "1970-01-01T00:00:00Z"

INDEX = "record_id string, page_id long, path string, frame int, offset long, length long"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    """The same for rows that share page_id and payload."""
    return f"urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}"


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to) -> tuple[str, bytes]:
    """A record's identifier and bytes; a revisit has HTTP headers alone."""
    digest = base32_sha1(payload)
    own = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at an offset, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    start, size = end + 4, int(head["Content-Length"])
    block = data[start : start + size]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    n, digest = int(head["X-Payload-Bytes"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and (len(payload), base32_sha1(payload)) != (n, digest):
        raise ValueError(f"record {head['WARC-Record-ID']}: the payload does not match its digest")
    number = lambda k: int(head[k]) if k in head else None
    return {
        "record_id": head["WARC-Record-ID"].strip("<>"),
        "page_id": number("X-Page-ID"),
        "url": head.get("WARC-Target-URI"),
        "record_type": head["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload_bytes": n,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }, start + size + 4


class Bundle:
    """Writes one bundle; ``add`` gives a record's frame, offset and length."""

    def __init__(self, out, frame_bytes: int, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.open, self.size, self.table, self.written = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        place = len(self.table), self.size, len(data)
        self.open.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.out.write(frame)
            self.table.append((len(frame), self.size))
            self.written += len(frame)
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(footer)) + footer)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame of a bundle."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    f.seek(size - 9 - 8 * n)
    out, start = [], 0
    for packed, full in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((start, packed, full))
        start += packed
    return out


def frame(f, at: tuple[int, int, int]) -> bytes:
    f.seek(at[0])
    return zstandard.ZstdDecompressor().decompressobj().decompress(f.read(at[1]))


def typed(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, record_type, refers_to): which records are revisits.

    Of equal payloads of ``revisit_bytes`` or more the smallest page_id is the
    response. Rows that repeat that page_id are responses too, and so is every
    row whose page_id is null or whose equals have null ids alone.
    """
    whole = text_or_empty("html")
    rows = pages.select("page_id", "url", whole.alias("html"), F.sha2(whole.cast("binary"), 256).alias("__sha"))
    first = rows.groupBy("__sha").agg(F.min("page_id").alias("__first"))
    revisit = (F.octet_length("html") >= revisit_bytes) & (F.col("page_id") > F.col("__first"))
    return rows.join(first, "__sha").select(
        "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__first")).alias("refers_to")
    )


def archived(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 27) -> DataFrame:
    """Writes all pages as bundles under ``folder`` and gives the written index.

    The folder (a URI that all executors can write to) is one of the session's
    workspace if None. Every task writes under names of its own and the index is
    a table that only tasks that succeeded add to, so a task run twice leaves a
    file that nothing names and never a record twice. Null html is an empty
    payload; empty tables give an empty index; other columns are not read.
    """
    spark = pages.sparkSession
    root = folder or new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = files(root)
        fs.create_dir(base, recursive=True)
        bundle, name, rows = None, "", []
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(rows, schema)
            rows.clear()
            return out

        for batch in batches:
            for page_id, url, html, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(fs.open_output_stream(f"{base}/{name}", compression=None), frame_bytes)
                own, data = record(page_id, url, html.encode(), kind, refers_to)
                place = bundle.add(data)
                rows.append({"record_id": own, "page_id": page_id, "path": f"{root}/{name}", "frame": place[0], "offset": place[1], "length": place[2]})
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            if bundle is None and rows:
                yield told()
        if bundle is not None:
            bundle.close()
        if rows:
            yield told()

    typed_pages = typed(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), revisit_bytes)
    return written(typed_pages.mapInArrow(write, INDEX), "warc-index")


def records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that an index names, read back and verified."""
    spark = index.sparkSession
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = files(path)
                with fs.open_input_file(name) as f:
                    for at in seek_table(f):
                        data, i, out = frame(f, at), 0, []
                        while i < len(data):
                            one, i = parsed(data, i)
                            out.append(one if payloads else one | {"payload": None})
                        yield pa.RecordBatch.from_pylist(out, schema)

    # Dealt out in turn and not by a hash of the path: what makes the paths distinct
    # is partitioned by that already, and is few rows that would be put in one task.
    paths = index.select("path").distinct()
    return paths.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(read, RECORDS)


def fetched(index: DataFrame, wanted: str) -> dict | None:
    """One record by identifier, from its own frame alone; None if unknown."""
    row = index.filter(F.col("record_id") == wanted).first()
    if row is None:
        return None
    fs, name = files(row["path"])
    with fs.open_input_file(name) as f:
        return parsed(frame(f, seek_table(f)[row["frame"]]), row["offset"])[0]


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """What the archives say of each page after writing and reading them back."""
    return records(archived(pages), payloads=False).drop("payload")
