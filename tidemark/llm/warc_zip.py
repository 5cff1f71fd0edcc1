"""WARC records in ZIP-packaged archives, read in place.

Each task packs its pages into one archive: a ZIP file whose members are stored, not deflated.
`archive/data.warc.gz` holds one gzip member per record, `indexes/index.cdxj` one line per record
with its place in that file. The reader finds the end-of-directory record (and its ZIP64 form),
parses the central directory, locates both members, and fetches each record by the range that
the index gives; nothing is extracted, and a record can be read without the others.

Records with equal payloads of `min_bytes` or more: the one with the least page id is a response,
the others are revisits that refer to it and carry no payload. Their HTTP headers keep its length.
Null html is an empty payload. Rows without a page id are not archived. Rows with equal ids and
payloads are a response each if theirs is the least id. An empty table gives an empty archive set.

Archives are written to the shared folder with `pyarrow.fs`, each under a name of its own, and reported by a
row: an attempt that was lost leaves a file that no row names, and only reported archives are read.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import over_batches
from tidemark.session import fresh_folder, stored

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the ZIP format: signatures, and the fields that follow them.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FIELDS, CENTRAL_FIELDS, END_FIELDS = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
END64_FIELDS, LOCATOR64_FIELDS = "<4sQ2H2I4Q", "<4sIQI"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
ARCHIVE_BYTES = 64 << 20  # a task begins another archive beyond this size


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class StoredZip:
    """Writes a ZIP file of stored members front to back; `zip64` forces the long forms."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.at, self.zip64, self.members = sink, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, start, crc = name.encode(), self.at, zlib.crc32(data)
        long = self.zip64 or len(data) >= MAX32
        extra = struct.pack("<2H2Q", 1, 16, len(data), len(data)) if long else b""
        size = MAX32 if long else len(data)
        self._put(struct.pack(LOCAL_FIELDS, LOCAL, 45 if long else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append((raw, start, crc, len(data)))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            long = self.zip64 or size >= MAX32 or at >= MAX32
            extra = struct.pack("<2H3Q", 1, 24, size, size, at) if long else b""
            s, a = (MAX32, MAX32) if long else (size, at)
            self._put(struct.pack(CENTRAL_FIELDS, CENTRAL, 45, 45 if long else 20, 0x800, 0, 0, 0x21, crc, s, s,
                                  len(raw), len(extra), 0, 0, 0, 0, a) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or n >= MAX16 or start >= MAX32 or size >= MAX32:
            at = self.at
            self._put(struct.pack(END64_FIELDS, END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack(LOCATOR64_FIELDS, LOCATOR64, 0, at, 1))
            n, size, start = MAX16, MAX32, MAX32
        self._put(struct.pack(END_FIELDS, END, 0, 0, n, n, size, start, 0))


def _at(source, offset: int, size: int) -> bytes:
    source.seek(offset)
    return source.read(size)


def members(source, size: int) -> dict[str, tuple[int, int]]:
    """Where the stored members of a ZIP file lie: name -> (offset, size)."""
    tail_at = max(0, size - 66_000)
    tail = _at(source, tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(END, 0, end)  # the signature may stand in a comment
    if end < 0:
        raise ValueError("no end of a central directory")
    _, _, _, _, n, length, start, _ = struct.unpack_from(END_FIELDS, tail, end)
    if n == MAX16 or length == MAX32 or start == MAX32:
        at = _at(source, tail_at + end - 20, 20)
        if at[:4] == LOCATOR64:
            at64 = struct.unpack(LOCATOR64_FIELDS, at)[2]
            end64 = struct.unpack(END64_FIELDS, _at(source, at64, 56))
            if end64[0] != END64:
                raise ValueError("broken ZIP64 end of central directory")
            n, length, start = end64[7], end64[8], end64[9]
    directory, found, at = _at(source, start, length), {}, 0
    for _ in range(n):
        f = struct.unpack_from(CENTRAL_FIELDS, directory, at)
        if f[0] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, whole, names, extras, comment, offset = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
        name = directory[at + 46:at + 46 + names].decode()
        extra = directory[at + 46 + names:at + 46 + names + extras]
        while len(extra) >= 4:
            kind, size_ = struct.unpack_from("<2H", extra)
            if kind == 1:  # the fields that did not fit, in this order
                longs = list(struct.unpack_from(f"<{size_ // 8}Q", extra, 4))
                whole = longs.pop(0) if whole == MAX32 else whole
                packed = longs.pop(0) if packed == MAX32 else packed
                offset = longs.pop(0) if offset == MAX32 else offset
            extra = extra[4 + size_:]
        if method == 0:
            local = struct.unpack(LOCAL_FIELDS, _at(source, offset, 30))
            if local[0] != LOCAL:
                raise ValueError(f"{name} is not where the directory says")
            found[name] = (offset + 30 + local[9] + local[10], packed)
        at += 46 + names + extras + comment
    return found


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Fields of one WARC record, and its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line[15:]) for line in http.decode().split("\r\n") if line.lower().startswith("content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    return fields | {"payload_bytes": length, "payload": None if revisit else payload}



def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def with_first(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 and first: the least page id with the same payload, null if too short."""
    p = pages.where(F.col(page_id).isNotNull()).select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    alike = p.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur again need a look-up. Written, so that a hot payload's join can be split.
    again = stored(alike.where("n > 1").select(F.col("sha1").alias("again"), "first"), "repeated-payloads")
    return p.join(again, F.col("sha1") == F.col("again"), "left").drop("again")


def write_archives(pages: DataFrame, folder: str, **names) -> DataFrame:
    """Packs `pages` into archives under `folder`; archive, n_records for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = io.BytesIO(), []

        def pack() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.zip"
            system, path = opened(uri)
            with system.open_output_stream(path, compression=None) as sink:
                z = StoredZip(sink)
                z.add(RECORDS, data.getvalue())
                z.add(INDEX, "".join(index).encode())
                z.close()
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(index)], pa.int64())], ["archive", "n_records"])

        for batch in batches:
            for page_id, url, payload, sha1, first in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "first")]):
                refers_to = first if first is not None and first != page_id else None
                raw = gzip.compress(record(page_id, url, payload, base32_of_hex(sha1), refers_to), 1, mtime=0)
                index.append(json.dumps({"url": url, "offset": data.tell(), "length": len(raw)}) + "\n")
                data.write(raw)
            if data.tell() > ARCHIVE_BYTES:
                yield pack()
                data, index = io.BytesIO(), []
        if index:
            yield pack()

    opened_folder, path = opened(folder)
    opened_folder.create_dir(path)
    return stored(with_first(pages, **names).mapInArrow(run, "archive string, n_records long"), "archives")


def index_records(archives: DataFrame) -> DataFrame:
    """archive, offset, length of every record, from the archives' own directories and indexes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for uri in batch.column("archive").to_pylist():
            system, path = opened(uri)
            with system.open_input_file(path) as source:
                found = members(source, source.size())
                at, size = found[INDEX]
                start = found[RECORDS][0]
                for line in _at(source, at, size).splitlines():
                    x = json.loads(line)
                    for column, value in zip(out, (uri, start + x["offset"], x["length"])):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
                                          ["archive", "offset", "length"])

    return over_batches(archives.select("archive"), work, "archive string, offset long, length long")


def read_records(places: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload of the records at `places`."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, source, open_ = [], None, None
        for uri, at, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")]):
            if uri != open_:
                system, path = opened(uri)
                source, open_ = system.open_input_file(path), uri
            r = parsed(gzip.decompress(_at(source, at, length)))
            refers = r.get("WARC-Refers-To")
            rows.append((int(r["WARC-Record-ID"][10:-1]), r["WARC-Target-URI"], r["WARC-Type"], int(refers[10:-1]) if refers else None,
                         r["WARC-Payload-Digest"].removeprefix("sha1:"), r["payload_bytes"], r["payload"]))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return over_batches(places, work, "page_id long, url string, record_type string, refers_to long, payload_digest string, "
                                      "payload_bytes long, payload binary")


def archive_and_read(pages: DataFrame, **names) -> DataFrame:
    """Writes `pages` to archives in the shared folder and reads all records back."""
    archives = write_archives(pages, fresh_folder(pages.sparkSession, "zip-archives"), **names)
    return read_records(index_records(archives.repartition(max(1, archives.count()))))
