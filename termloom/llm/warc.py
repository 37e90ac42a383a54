"""WARC archives: a monolithic gzip normaliser with a sidecar offset index.

``write`` makes archives in which a whole file is one gzip stream.  ``normalise`` inflates such
a stream once, in blocks, rewrites every record as a gzip member of its own and writes a sidecar
index of the members' offsets; given the rows that revisit others, it rewrites those records as
revisits without payload.  ``read`` opens ranges of a sidecar, seeks to the members, checks the
payload digests and returns a row per record.

A stream can't be entered in its middle, so one file is one task; ``write`` starts a new file at
``FILE_BYTES`` or ``FILE_RECORDS``.  Payloads are copied in blocks, never held beside each other.
Each attempt of a task writes files of its own name, and only files that a finished task has
listed are read, so a lost executor leaves nothing behind that counts.

Files are opened through pyarrow's file systems, in the shared folder.

Edge cases: a null or empty page has an empty payload, a record like any other; control
characters of a URL are percent-encoded and a null URL is left out; rows that repeat a page_id
with the same payload: one is the response, the others revisit it; null page_ids come last in
the choice of the response; an empty table writes no archive and reads no row; other columns do
not matter.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import folder, materialise, partitions, remove

FILE_BYTES = 256 << 20
FILE_RECORDS = 50_000
#: Records of a range that one reading step opens.
RANGE = 512
READ = 1 << 20
#: Compressed bytes inflated at once.
INFLATE = 1 << 16
END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    name = record_id.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str) -> Iterator[bytes]:
    """A response record in parts."""
    http = _http(len(payload))
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))))))
    fields += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    yield _header(fields)
    yield http
    yield payload
    yield END


def _open(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if re.match(r"\w+:", path) else FileSystem.from_uri("file://" + path)


class _Archive:
    """A monolithic gzip stream being written."""

    def __init__(self, home: str):
        fs, at = _open(home)
        fs.create_dir(at)
        self.path = f"{home}/{uuid.uuid4().hex}.warc.gz"
        fs, at = _open(self.path)
        self.out, self.gzip, self.bytes, self.records = fs.open_output_stream(at, compression=None, buffer_size=READ), zlib.compressobj(1, wbits=31), 0, 0

    def add(self, parts: Iterator[bytes]) -> int:
        for part in parts:
            self.out.write(self.gzip.compress(part))
            self.bytes += len(part)
        self.records += 1
        return self.records - 1

    def close(self) -> None:
        self.out.write(self.gzip.flush())
        self.out.close()


def write(pages: DataFrame, home: str) -> DataFrame:
    """Write archives under ``home``; the log has (file, ordinal, page_id, payload_bytes, sha1) of each record."""

    def run(batches):
        archive = None
        for batch in batches:
            out = [], [], [], [], []
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                payload = html or b""
                if archive and (archive.bytes > FILE_BYTES or archive.records >= FILE_RECORDS):
                    archive.close()
                    archive = None
                archive = archive or _Archive(home)
                sha1 = digest(payload)
                ordinal = archive.add(record(page, url, payload, sha1))
                for column, value in zip(out, (archive.path, ordinal, page, len(payload), sha1)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["file", "ordinal", "page_id", "payload_bytes", "sha1"])
        if archive:
            archive.close()

    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    return materialise(rows.mapInArrow(run, "file string, ordinal int, page_id long, payload_bytes long, sha1 string"), "warc-log")


def revisits(log: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(file, ordinal, refers_to) of the records that repeat a payload of ``least_bytes`` or more.

    The first of each digest is found by a minimum that is taken before the shuffle; only digests
    that occur twice go on, and a hot digest's rows may be split in the join.
    """
    key = F.struct(F.col("page_id").isNull().alias("no"), "page_id", "file", "ordinal")
    large = log.where(F.col("payload_bytes") >= least_bytes)
    first = large.groupBy("sha1").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = large.join(first, "sha1").where(~((F.col("file") == F.col("first.file")) & (F.col("ordinal") == F.col("first.ordinal"))))
    return joined.select("file", "ordinal", F.col("first.page_id").alias("refers_to"))


class _Inflated:
    """A gzip stream read once, in blocks."""

    def __init__(self, source):
        self.source, self.zip, self.held = source, zlib.decompressobj(wbits=31), b""

    def _more(self) -> bool:
        while True:
            data = (self.zip.unused_data if self.zip.eof else b"") or self.source.read(INFLATE)
            if not data:
                return False
            if self.zip.eof:  # the file may hold several members
                self.zip = zlib.decompressobj(wbits=31)
            if got := self.zip.decompress(data):
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``; empty at the end of the stream."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends within a header")
                return b""
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def blocks(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            part, self.held = self.held[:length], self.held[length:]
            length -= len(part)
            yield part


def fields(header: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in header.decode().split("\r\n")[1:] if line)


def normalise_file(source, out, index, refers: dict[int, int | None]) -> list[tuple[int, int, int]]:
    """Rewrite one stream; ``refers`` has the ordinals that become revisits.  Returns (records, index from, to) by range."""
    stream, at, where, ordinal, ranges = _Inflated(source), 0, 0, 0, []
    while header := stream.until(END):
        have, member, size = fields(header), zlib.compressobj(6, wbits=31), 0
        length = int(have["Content-Length"])

        def put(part: bytes, member=member) -> None:
            nonlocal size
            got = member.compress(part)
            size += len(got)
            out.write(got)

        if ordinal in refers:
            http = stream.until(END)
            for _ in stream.blocks(length - len(http)):
                pass
            have |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers[ordinal]), "Content-Length": str(len(http))}
            put(_header(list(have.items())))
            put(http)
        else:
            put(header)
            for part in stream.blocks(length):
                put(part)
        put(b"".join(stream.blocks(len(END))))
        tail = member.flush()
        out.write(tail)
        size += len(tail)
        line = json.dumps({"offset": at, "length": size, "type": have["WARC-Type"], "id": have["WARC-Record-ID"], "digest": have.get("WARC-Payload-Digest")}).encode() + b"\n"
        index.write(line)
        if ordinal % RANGE == 0:
            ranges.append([0, where, where])
        ranges[-1] = [ranges[-1][0] + 1, ranges[-1][1], where + len(line)]
        at, where, ordinal = at + size, where + len(line), ordinal + 1
    return [tuple(r) for r in ranges]


def normalise(log: DataFrame, again: DataFrame, home: str) -> DataFrame:
    """Rewrite every file of ``log``; returns (archive, sidecar, records, index_from, index_to) by range of records."""
    per = again.groupBy("file").agg(F.collect_list(F.struct("ordinal", "refers_to")).alias("again"))  # bounded by FILE_RECORDS
    files = materialise(log.groupBy("file").agg(F.count(F.lit(1)).alias("records")).join(per, "file", "left"), "warc-files")

    def run(batches):
        for batch in batches:
            out = [], [], [], [], []
            for path, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{home}/{uuid.uuid4().hex}"
                (src, a), (dst, b), (side, c) = _open(path), _open(name + ".warc.gz"), _open(name + ".idx")
                dst.create_dir(_open(home)[1])
                with src.open_input_stream(a, compression=None, buffer_size=READ) as source, dst.open_output_stream(b, compression=None, buffer_size=READ) as archive, side.open_output_stream(c, compression=None, buffer_size=READ) as index:
                    ranges = normalise_file(source, archive, index, {r["ordinal"]: r["refers_to"] for r in rows or ()})
                for r in ranges:
                    for column, value in zip(out, (name + ".warc.gz", name + ".idx", *r)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["archive", "sidecar", "records", "index_from", "index_to"])

    n = max(1, min(files.count(), 16 * partitions(log.sparkSession)))
    spread = files.select("file", "again").repartition(n)
    return materialise(spread.mapInArrow(run, "archive string, sidecar string, records int, index_from long, index_to long"), "warc-ranges")


def member(data: bytes) -> dict:
    """A record of one member: its page_id, payload_bytes, payload_digest, record_type, refers_to and payload."""
    raw = zlib.decompress(data, wbits=31)
    header, _, rest = raw.partition(END)
    have = fields(header + END)
    block = rest[: int(have["Content-Length"])]
    http, _, payload = block.partition(END)
    sha1, kind = have["WARC-Payload-Digest"].removeprefix("sha1:"), have["WARC-Type"]
    if kind == "response" and digest(payload) != sha1:
        raise ValueError(f"payload of {have['WARC-Record-ID']} does not match its digest")
    refers = _page_id(have["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": _page_id(have["WARC-Record-ID"]), "payload_bytes": int(fields(http + END)["Content-Length"]), "payload_digest": sha1, "record_type": kind, "refers_to": refers, "payload": payload if kind == "response" else None}


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(ranges: DataFrame, payload: bool = False) -> DataFrame:
    """A row per record, by seeking to the members that the sidecars name; ``payload`` adds the payload of responses."""
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def run(batches):
        for batch in batches:
            for archive, sidecar, _, first, last in zip(*(batch.column(i).to_pylist() for i in range(5))):
                (fs, a), (side, b) = _open(archive), _open(sidecar)
                rows, held = [], 0
                with fs.open_input_file(a) as file, side.open_input_file(b) as index:
                    for line in index.read_at(last - first, first).splitlines():
                        entry = json.loads(line)
                        rows.append(member(file.read_at(entry["length"], entry["offset"])))
                        held += rows[-1]["payload_bytes"]
                        if held > 64 * READ:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                yield _batch(rows, names, kinds)

    n = max(1, min(ranges.count(), 4 * partitions(ranges.sparkSession)))
    return ranges.repartition(n).mapInArrow(run, RECORD + ", payload binary" * payload)


def _batch(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names=names)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, find revisits, normalise: the ranges of the finished archives."""
    spark = pages.sparkSession
    raw, home = folder(spark, "warc-raw"), folder(spark, "warc")
    log = write(pages, raw)
    ranges = normalise(log, revisits(log, least_bytes), home)
    remove(spark, raw)
    return ranges
