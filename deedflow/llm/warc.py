"""WARC archives packed in ZIP files: writing, and reading by ranges without extraction.

An archive holds stored members ``archive/data-N.warc.gz`` (a gzip member for each record) and ``indexes/index.cdxj`` (a
line for each record: where it lies).  The reader finds the end record (and the ZIP64 one) from the file's tail, walks the
central directory, locates the stored members, reads the index and then fetches each record by its range.

Archives are written by the tasks themselves to the shared folder, through ``pyarrow.fs`` (any file system it knows by the
folder's URI), under names of their own; the table of archives holds only those of tasks that ended, so a repeated or lost
task leaves no double records.

Defined cases: null html is an empty payload; a null url is written as ``urn:page:ID``; a null page_id reads back as null;
rows that repeat a page_id each get a record, and all that have the largest page_id of their payload are responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, scratch

MEMBER_BYTES = 8 << 20
ARCHIVE_BYTES = 512 << 20
#: Payloads of at least so many bytes are looked for among each other.
LEAST_BYTES = 0
SALTS = 16
DATE = "2024-01-01T00:00:00Z"

# The ZIP format's signatures and layouts.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def one_line(text: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record with the payload, or a revisit record with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {one_line(url if url is not None else f'urn:page:{page_id}')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    block = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> tuple[dict[str, str], int]:
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}, end + 4


def read_record(raw: bytes) -> dict:
    """Fields of an uncompressed record; a payload that does not fit its digest raises."""
    head, at = parse_head(raw)
    block = raw[at : at + int(head["content-length"])]
    http, body = parse_head(block)
    digest, payload = head["warc-payload-digest"].removeprefix("sha1:"), block[body:]
    if head["warc-type"] == "response" and (digest_of(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"the payload of {head['warc-record-id']} does not fit its digest")
    number = lambda name: int(head[name]) if name in head else None
    return {
        "page_id": number("x-page-id"), "url": head["warc-target-uri"], "payload_bytes": int(http["content-length"]), "payload_digest": digest,
        "record_type": head["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload": payload if head["warc-type"] == "response" else None,
    }


class ArchiveWriter:
    """Writes one ZIP file to a stream, member by member."""

    def __init__(self, stream, member_bytes: int = MEMBER_BYTES):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member_bytes, self.parts, self.size, self.no, self.index, self.total = member_bytes, [], 0, 0, [], 0

    def add(self, record: bytes, page_id: int | None) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.index.append(json.dumps({"page": page_id, "member": f"archive/data-{self.no}.warc.gz", "offset": self.size, "length": len(packed)}))
        self.parts.append(packed)
        self.size += len(packed)
        self.total += len(packed)
        if self.size >= self.member_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.parts:
            self._put(f"archive/data-{self.no}.warc.gz", b"".join(self.parts))
            self.parts, self.size, self.no = [], 0, self.no + 1

    def _put(self, name: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)

    def close(self) -> int:
        self._flush()
        self._put("indexes/index.cdxj", "\n".join(self.index).encode())
        self.zip.close()
        return len(self.index)


class ZipDirectory:
    """The members of a ZIP file that can be read at any offset."""

    def __init__(self, file, size: int):
        self.file = file
        tail_at = max(0, size - (22 + FULL16 + 20))
        tail = self.range(tail_at, size - tail_at)
        at = self._end_record(tail)
        count, length, start = struct.unpack_from("<H2I", tail, at + 10)
        shift = 0
        if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
            (where,) = struct.unpack_from("<Q", tail, at - 12)
            raw = self.range(where, 56)
            if raw[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack_from("<3Q", raw, 32)
        elif FULL32 in (length, start) or count == FULL16:
            raise ValueError("the ZIP64 locator is missing")
        else:
            shift = tail_at + at - length - start  # bytes put before the first member
        self.members = dict(self._central(self.range(start + shift, length), count, shift))

    @staticmethod
    def _end_record(tail: bytes) -> int:
        at = tail.rfind(END)
        while at >= 0:
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                return at
            at = tail.rfind(END, 0, at)
        raise ValueError("not a ZIP file")

    @staticmethod
    def _central(raw: bytes, count: int, shift: int) -> Iterator[tuple[str, tuple[int, int, int, int]]]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, packed, plain = struct.unpack_from("<10xH8x2I", raw, at)
            n_name, n_extra, n_comment = struct.unpack_from("<28x3H", raw, at)
            (header,) = struct.unpack_from("<42xI", raw, at)
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<2H", extra)
                if kind == 1:  # the fields that are full, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    plain = next(wide) if plain == FULL32 else plain
                    packed = next(wide) if packed == FULL32 else packed
                    header = next(wide) if header == FULL32 else header
                extra = extra[4 + n :]
            yield name, (method, header + shift, packed, plain)
            at += 46 + n_name + n_extra + n_comment

    def range(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError("the file ends early")
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's data in the file."""
        method, header, packed, _ = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        local = self.range(header, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        n_name, n_extra = struct.unpack_from("<26x2H", local)
        return header + 30 + n_name + n_extra, packed


def open_archive(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def payload_keepers(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, keeper): the largest page_id of payloads that occur more than once."""
    return (
        pages.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes)
        .groupBy(F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """Writes all pages and returns (path, n_records) of the archives; materialize it before reading."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    keepers = payload_keepers(pages, least_bytes)
    # A payload may be that of a third of all pages: its pages are dealt to SALTS keys.
    marked = (
        pages.withColumn("digest", F.when(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes, F.sha1(F.coalesce("html", F.lit("")))))
        .withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        .join(keepers.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))), ["digest", "salt"], "left")
        .select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("keeper")), None).otherwise(F.col("keeper")).alias("refers_to"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pafs.FileSystem.from_uri(folder)
        writer = path = stream = None

        def close() -> pa.RecordBatch:
            n = writer.close()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for page in batch.slice(at, 200).to_pylist():
                    if writer is None:
                        fs.create_dir(inner, recursive=True)
                        name = f"{uuid.uuid4().hex}.zip"
                        path, stream = f"{folder}/{name}", fs.open_output_stream(f"{inner}/{name}")
                        writer = ArchiveWriter(stream, member_bytes)
                    writer.add(make_record(page["page_id"], page["url"], (page["html"] or "").encode(), page["refers_to"]), page["page_id"])
                    if writer.total >= archive_bytes:
                        yield close()
                        writer = None
        if writer is not None:
            yield close()

    return marked.mapInArrow(write, "path string, n_records long")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of the archives of column path: directories and indexes first, then each record by its range."""
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_archive(path) as file:
                    zipped = ZipDirectory(file, file.size())
                    ranges: dict[str, list[tuple[int, int]]] = {}
                    for name in zipped.members:
                        if name.startswith("indexes/"):
                            for line in zipped.range(*zipped.locate(name)).decode().splitlines():
                                entry = json.loads(line)
                                ranges.setdefault(entry["member"], []).append((entry["offset"], entry["length"]))
                    for name, own in ranges.items():
                        start, _ = zipped.locate(name)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path]), pa.array([[start + o for o, _ in own]], pa.list_(pa.int64())), pa.array([[n for _, n in own]], pa.list_(pa.int64()))], ["path", "starts", "lengths"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path, starts, lengths = (batch.column(i)[row].as_py() for i in range(3))
                with open_archive(path) as file:
                    found = []
                    for start, length in zip(starts, lengths, strict=True):
                        file.seek(start)
                        got = read_record(zlib.decompress(file.read(length), 31))
                        payload = got.pop("payload")
                        found.append(got | {"html": None if payload is None else payload.decode()})
                yield pa.RecordBatch.from_pylist(found, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())]))

    n = partitions(archives.sparkSession)
    return (
        archives.select("path").mapInArrow(members, "path string, starts array<long>, lengths array<long>")
        .repartition(n).mapInArrow(records, RECORD)
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages and reads all records back."""
    spark = pages.sparkSession
    archives = materialize(write_archives(pages, scratch(spark)))
    return read_archives(archives)
