"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table and an index of record ids."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import urllib.parse

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stored

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 128 << 10
BUNDLE_BYTES = 1 << 20
BUNDLE_SCHEMA = (
    "bundle_id string, blob binary, "
    "index array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"
)


def _uri(page: int | None, digest: str) -> str:
    return f"urn:page:{'null' if page is None else page}:{digest}"


def _page(uri: str) -> int | None:
    page = uri.split(":")[2]
    return None if page == "null" else int(page)


def record(page: int | None, url: str | None, payload: bytes, owner: int | None, revisit: bool, date: str) -> tuple[str, bytes]:
    """(record id, the WARC record). A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = _uri(page, digest)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{uri}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{_uri(owner, digest)}>")
    return uri, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record at an offset, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} isn't closed")
    return headers, data[start:stop], stop + 4


class Bundle:
    """Gathers records into frames of about frame_bytes, each compressed on its own."""

    def __init__(self, frame_bytes: int):
        self.frame_bytes, self.size = frame_bytes, 0
        self.frames: list[tuple[bytes, int]] = []
        self.open, self.open_size = [], 0
        self.index: list[dict] = []
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, uri: str, data: bytes) -> None:
        self.index.append({"record_id": uri, "frame": len(self.frames), "offset": self.open_size, "length": len(data)})
        self.open.append(data)
        self.open_size += len(data)
        if self.open_size >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append((frame, self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def bytes(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", len(frame), n) for frame, n in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        skip = struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer))
        return b"".join(frame for frame, _ in self.frames) + skip + table + footer


def seek_table(blob: bytes) -> list[tuple[int, int, int]]:
    """(where a frame starts, its compressed size, its full size), read from the end of the bundle."""
    n, flags, magic = struct.unpack("<IBI", blob[-9:])
    if magic != SEEKABLE_MAGIC or flags & 0x80:
        raise ValueError("no seek table without checksums at the end")
    entries = [struct.unpack_from("<II", blob, len(blob) - 9 - 8 * (n - i)) for i in range(n)]
    out, at = [], 0
    for compressed, full in entries:
        out.append((at, compressed, full))
        at += compressed
    if struct.unpack_from("<II", blob, at) != (SKIPPABLE_MAGIC, 8 * n + 9):
        raise ValueError("the seek table's frame isn't where its entries end")
    return out


def frame_of(blob: bytes, k: int) -> bytes:
    at, compressed, full = seek_table(blob)[k]
    return zstandard.ZstdDecompressor().decompress(blob[at : at + compressed], max_output_size=full)


def read_record(blob: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index; only its frame is decompressed."""
    return parse(frame_of(blob, frame), offset)[:2]


def write_bundles(
    pages: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> Stored:
    """The bundles as a table in the shared folder: bundle_id, blob and the index of its records.

    Of equal payloads of at least min_bytes the largest page_id is the response and the others revisit it.
    Null html is an empty payload; a null page_id is below all others, and is kept as null; rows that repeat
    the responding page_id with the same payload are responses too (the same record twice); an empty table gives no
    bundle; other columns play no part. The payload moves once, to the join with its digest's largest id.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # stored, so that the join is between plain shuffles, which Spark splits where one payload has very many pages
    owners = Stored(rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page").alias("owner"))).df
    told = rows.join(owners, "digest", "left").select(
        "page", "url", "payload", "owner",
        (F.octet_length("payload").__ge__(min_bytes) & ~F.col("page").eqNullSafe(F.col("owner"))).alias("revisit"),
    )

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        schema = pa.schema([
            ("bundle_id", pa.string()), ("blob", pa.binary()),
            ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
        ])
        bundle = Bundle(frame_bytes)

        def done():
            return pa.RecordBatch.from_pylist([{"bundle_id": f"{part:06d}-{n:06d}", "blob": bundle.bytes(), "index": bundle.index}], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                page, link, body, owner, revisit = (c[i].as_py() for c in batch.columns)
                bundle.add(*record(page, link, body, owner, revisit, date))
                if bundle.size >= bundle_bytes:
                    yield done()
                    bundle, n = Bundle(frame_bytes), n + 1
        if bundle.index:
            yield done()

    return Stored(told.mapInArrow(run, BUNDLE_SCHEMA))


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row per record of the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Each response's digest is computed again and held against its header; a mismatch fails the read.
    """

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                out = []
                for k in range(len(seek_table(blob))):
                    data, at = frame_of(blob, k), 0
                    while at < len(data):
                        headers, block, at = parse(data, at)
                        head, body = block.split(b"\r\n\r\n", 1)
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind, refers = headers["WARC-Type"], None
                        size = int(head.rsplit(b"Content-Length: ", 1)[1])
                        if kind == "revisit":
                            refers = _page(headers["WARC-Refers-To"].strip("<>"))
                        elif len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                        out.append((_page(headers["WARC-Record-ID"].strip("<>")), size, digest, kind, refers))
                page, size, digest, kind, refers = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.int64())],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return bundles.select("blob").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def fetch_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """record_id, headers (a map) and block of each record of bundles whose id is in wanted (record_id), by the index: only its frame is decompressed.

    An id that is asked for twice is given once; one that no bundle holds gives no row; a record that is held twice gives two.
    """
    asked = wanted.select("record_id").distinct()
    places = bundles.select("bundle_id", F.inline("index")).join(asked, "record_id", "left_semi")
    grouped = places.groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "frame", "offset")).alias("places"))

    def run(batches):
        for batch in batches:
            for blob, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for at in range(0, len(places), 100):
                    part = places[at : at + 100]
                    told = [read_record(blob, x["frame"], x["offset"]) for x in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["record_id"] for x in part]), pa.array([list(h.items()) for h, _ in told], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in told], pa.binary())],
                        names=["record_id", "headers", "block"],
                    )

    held = bundles.select("bundle_id", "blob").join(grouped, "bundle_id")
    return held.select("blob", "places").mapInArrow(run, "record_id string, headers map<string,string>, block binary")


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as a .warc.zst file to a mounted folder that executors share; returns bundle_id and path.

    A file appears under its name only when it is whole, so a task that is run again does no harm.
    """

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            paths = []
            for name, blob in zip(names, batch.column(1).to_pylist(), strict=True):
                paths.append(os.path.join(folder, f"{name}.warc.zst"))
                with open(part := f"{paths[-1]}.{TaskContext.get().taskAttemptId()}", "wb") as out:
                    out.write(blob)
                os.replace(part, paths[-1])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(paths)], names=["bundle_id", "path"])

    return bundles.select("bundle_id", "blob").mapInArrow(run, "bundle_id string, path string")
