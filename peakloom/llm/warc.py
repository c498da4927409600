"""WARC archives in seekable Zstandard bundles, and reading them back by their seek tables.

A bundle is a run of independent Zstandard frames, each of whole records, and a last skippable frame that holds the seek
table: compressed and plain size of every frame, number of frames, and a closing magic number. A record is found by bundle,
frame and offset within the plain frame, without decoding any other frame.

Bundles are rows (bundle_id, archive, index) of a table, so that Spark's own writer commits them on any store, once each,
whatever executors are lost; ``export`` writes them as .warc.zst files. Bundles and frames have bounded sizes, save that a
single record larger than a frame is a frame, and a bundle, of its own.

The index maps each record's id, and its page's, to bundle, frame and offset; ``records`` and ``lookup`` read through it.

Of records with equal payloads of at least ``least`` bytes the one with the largest id is a response and the others
revisit it. That is decided on ids and digests alone, whose counts are pre-aggregated and written; only then are pages joined,
by id and digest, with the revisits, so a payload held by a third of all pages is neither sorted in one task nor joined to itself.

A response has an HTTP block of status line, type and length before its payload; a revisit has the block alone. Every record has an
id of its own, of its bundle and place; dates are the caller's, or that of the call. Defined cases: null html is an
empty payload; smaller payloads are all responses; null ids never are referred to, and rows that repeat the id of their
group's response are responses too, since they can't refer to themselves; repeated rows are records each; an empty table gives
no bundles; a payload of any length is one record; columns beside key, url and html are not read, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import durable, removed

LEAST, FRAME, BUNDLE, LEVEL = 1000, 256 << 10, 4 << 20, 3
#: Fixed values of the seekable format: a skippable frame's magic number, and the seek table's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "array<struct<record_id:string,page_id:bigint,frame:int,offset:int,length:int>>"


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP header without the payload, whose size and digest it keeps."""
    line = lambda name, value: f"{name}: {value}"
    clean = lambda link: "".join((link or "").split())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", line("WARC-Type", "response" if refers_to is None else "revisit"), line("WARC-Record-ID", f"<{record_id}>"), line("WARC-Date", date)]
    head += [line("WARC-Target-URI", clean(url)), line("WARC-Payload-Digest", f"sha1:{digest}"), line("X-Payload-Length", len(payload))]
    head += [line("X-Page-ID", page_id)] if page_id is not None else []
    if refers_to is not None:
        head += [line("WARC-Profile", PROFILE), line("WARC-Refers-To-Target-URI", clean(refers_url)), line("WARC-Refers-To-Date", date), line("X-Refers-To-Page", refers_to)]
    head += [line("Content-Type", "application/http; msgtype=response"), line("Content-Length", len(body))]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def payload_of(block: bytes) -> bytes:
    """What follows the header of an HTTP block."""
    return block[block.index(b"\r\n\r\n") + 4 :]


def parse(data: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the record at an offset."""
    end = data.index(b"\r\n\r\n", offset)
    first, *lines = data[offset:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {offset}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    stop = end + 4 + int(headers["Content-Length"])
    return headers, data[end + 4 : stop], stop + 4


class Bundle:
    """Collects records into frames and closes them with the seek table."""

    def __init__(self, frame: int = FRAME, level: int = LEVEL):
        self.name = uuid.uuid4()
        self.frame, self.packer = frame, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.sizes, self.index, self.open, self.plain = [], [], [], bytearray(), 0

    def add(self, name: str, page_id: int | None, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > self.frame:
            self._flush()
        self.index.append({"record_id": name, "page_id": page_id, "frame": len(self.frames), "offset": len(self.open), "length": len(data)})
        self.open += data
        self.plain += len(data)

    def _flush(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), len(self.open)))
        self.open = bytearray()

    def close(self) -> bytes:
        if self.open:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


class Reader:
    """Reads frames of an archive by its seek table."""

    def __init__(self, archive: bytes):
        count, _, magic = struct.unpack("<IBI", archive[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        start, self.archive, self.frames, at = len(archive) - 9 - 8 * count, archive, [], 0
        for packed, plain in struct.iter_unpack("<II", archive[start : start + 8 * count]):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, n: int) -> bytes:
        at, packed, plain = self.frames[n]
        return zstandard.ZstdDecompressor().decompress(self.archive[at : at + packed], max_output_size=plain)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records in order, without an index."""
        for n in range(len(self.frames)):
            data, at = self.frame(n), 0
            while at < len(data):
                headers, body, at = parse(data, at)
                yield headers, body

    def mapped(self, places: list[dict]) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records at (frame, offset, length), each frame decoded once."""
        last, data = None, b""
        for p in sorted(places, key=lambda p: (p["frame"], p["offset"])):
            if p["frame"] != last:
                last, data = p["frame"], self.frame(p["frame"])
            headers, body, end = parse(data, p["offset"])
            if headers["WARC-Record-ID"] != f"<{p['record_id']}>" or end - p["offset"] != p["length"]:
                raise ValueError(f"{p['record_id']} isn't where its index says")
            yield headers, body

    def at(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        headers, body, _ = parse(self.frame(frame), offset)
        return headers, body


def revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", *, least: int = LEAST) -> DataFrame:
    """(of, digest, refers_to, refers_url): for each page and digest that revisits, the response's page; written once."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    large = pages.select(F.col(key).cast("long").alias("of"), F.col(url).cast("string").alias("url"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    large = durable(large.groupBy("digest", "of").agg(F.max("url").alias("url"), F.count("*").alias("n")), "digests")
    chosen = large.groupBy("digest").agg(F.sum("n").alias("n"), F.max(F.when(F.col("of").isNotNull(), F.struct("of", "url"))).alias("m")).where("n > 1 AND m IS NOT NULL")
    chosen = durable(chosen.select("digest", F.col("m.of").alias("refers_to"), F.col("m.url").alias("refers_url")), "chosen")
    found = durable(large.join(chosen, "digest").where(~F.col("of").eqNullSafe(F.col("refers_to"))).select("of", "digest", "refers_to", "refers_url"), "revisits")
    removed(large, chosen)
    return found


def bundles(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", *, least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE, date: str | None = None) -> DataFrame:
    """(bundle_id, records, archive, index) for all pages."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    again = revisits(pages, key, url, html, least=least).withColumnRenamed("digest", "same")
    # Pages without an id meet a stand-in with their digest, so that they aren't one key.
    own = lambda of, digest: F.coalesce(of.cast("string"), digest)
    rows = rows.join(again, (own(F.col("page_id"), F.col("digest")) == own(F.col("of"), F.col("same"))) & (F.col("digest") == F.col("same")) & F.col("page_id").eqNullSafe(F.col("of")), "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(one: Bundle) -> pa.RecordBatch:
            row = {"bundle_id": str(one.name), "records": len(one.index), "archive": one.close(), "index": one.index}
            return pa.RecordBatch.from_pylist([row], schema=layout)

        entry = pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])
        layout = pa.schema([("bundle_id", pa.string()), ("records", pa.int64()), ("archive", pa.binary()), ("index", pa.list_(entry))])
        now = Bundle(frame)
        for batch in batches:
            for cells in zip(*batch.columns, strict=True):
                page_id, link, body, digest, to, to_link = (c.as_py() for c in cells)
                if now.index and now.plain + len(body) > bundle:
                    yield done(now)
                    now = Bundle(frame)
                record_id = f"urn:uuid:{uuid.uuid5(now.name, str(len(now.index)))}"
                now.add(record_id, page_id, record(record_id, page_id, link, body, digest, date, to, to_link))
        if now.index:
            yield done(now)

    return rows.select("page_id", "url", "payload", "digest", "refers_to", "refers_url").mapInArrow(pack, f"bundle_id string, records long, archive binary, index {_INDEX}")


def records(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_id, record_type, payload_bytes, payload_digest, refers_to, payload) of every record, read through the index.

    A record that isn't where the index says is an error, as is a response's payload that differs from its digest.
    """
    layout = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    number = lambda x: int(x) if x is not None else None

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, places in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for h, block in Reader(cell.as_py()).mapped(places.as_py()):
                    body = payload_of(block)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{h['WARC-Record-ID']}: payload and digest differ")
                    rows.append((number(h.get("X-Page-ID")), h["WARC-Target-URI"], h["WARC-Record-ID"][1:-1], h["WARC-Type"], int(h["X-Payload-Length"]), digest, number(h.get("X-Refers-To-Page")), body))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), layout, strict=True)], schema=layout)

    return archives.select("archive", "index").mapInArrow(unpack, "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def index(archives: DataFrame) -> DataFrame:
    """record_id and page_id -> bundle_id, frame, offset and length within the plain frame."""
    return archives.select("bundle_id", F.inline("index"))


def lookup(archives: DataFrame, wanted: DataFrame, record_id: str = "record_id") -> DataFrame:
    """(record_id, headers, body) of the wanted records; decodes only the frames that hold them. The body is the HTTP block."""
    places = index(archives).join(wanted.select(F.col(record_id).alias("record_id")).distinct(), "record_id")
    found = durable(places.groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("places")), "places").join(archives.select("bundle_id", "archive"), "bundle_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, places in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(h["WARC-Record-ID"][1:-1], h, body) for h, body in Reader(archive.as_py()).mapped(places.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([list(r[1].items()) for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r[2] for r in rows], pa.binary())], names=["record_id", "headers", "body"])

    return found.select("archive", "places").mapInArrow(read, "record_id string, headers map<string,string>, body binary")


def export(archives: DataFrame, uri: str) -> DataFrame:
    """Writes each bundle as <bundle_id>.warc.zst under a location that executors reach (a shared path or an object store's address).

    Returns (bundle_id, bytes) rows that write as they are computed; a file gets its name only when it is whole.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        for batch in batches:
            sizes = []
            for name, archive in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{path}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(archive.as_buffer())
                store.move(part, f"{path}/{name}.warc.zst")
                sizes.append(len(archive.as_buffer()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["bundle_id", "bytes"])

    return archives.select("bundle_id", "archive").mapInArrow(put, "bundle_id string, bytes long")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", **sizes: int) -> DataFrame:
    """Writes the archives to a table in the shared folder and returns it, to be read by ``records``, ``index`` and ``lookup``."""
    return durable(bundles(pages, key, url, html, **sizes), "warc")
