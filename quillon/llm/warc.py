"""WARC records in ZIP-packaged archives, read by ranges without extraction.

An archive is a ZIP file with two stored members: archive/data.warc.gz, WARC
records that are each a gzip member of their own, and indexes/index.txt, a line
of offset and length for each record. Sizes and offsets are in ZIP64 fields.
A reader fetches the end of the file, the central directory and the index, then
ranges of records; nothing is unpacked to disk and no member is read whole
unless all its records are asked for.

Archives are written and read by executors through pyarrow.fs, which has local
and object stores and HDFS. An archive gets its name only when it is whole, and
the manifest lists those that the finished tasks wrote, so a task that is run
again leaves nothing that counts.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import bounded, new_path, slices, stored

#: Payloads of fewer bytes are stored again each time.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
#: Records that are fetched by one range read, and the bytes after which a range ends earlier.
RANGE_RECORDS, RANGE_BYTES = 512, 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.txt"
LOCAL, CENTRAL, DESCRIPTOR, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x07\x08", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
BIG, MANY = 0xFFFFFFFF, 0xFFFF


def store(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub("^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri)


class ZipWriter:
    """Stored members of any size, one after another, to a stream that need not seek."""

    def __init__(self, stream):
        self.stream, self.at, self.members = stream, 0, []

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.put(LOCAL + struct.pack("<5H3I2H", 45, 0x808, 0, 0, 0x21, 0, BIG, BIG, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        member = self.members[-1]
        member[2], member[3] = zlib.crc32(data, member[2]), member[3] + len(data)
        self.put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self.put(DESCRIPTOR + struct.pack("<IQQ", crc, size, size))

    def close(self) -> None:
        begin = self.at
        for raw, at, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self.put(CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 0x808, 0, 0, 0x21, crc, BIG, BIG, len(raw), len(extra), 0, 0, 0, 0, BIG) + raw + extra)
        size, at = self.at - begin, self.at
        self.put(END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, len(self.members), len(self.members), size, begin))
        self.put(LOCATOR + struct.pack("<IQI", 0, at, 1))
        self.put(END + struct.pack("<4H2IH", 0, 0, MANY, MANY, BIG, BIG, 0))


def read_range(file, at: int, size: int) -> bytes:
    file.seek(at)
    got = file.read(size)
    if len(got) != size:
        raise ValueError(f"the archive ends at {at + len(got)}, before {at + size}")
    return got


def directory(file) -> dict[str, tuple[int, int, int]]:
    """Name to (method, offset of the data, size) for each member, from the central directory."""
    length = file.size()
    tail = read_range(file, max(0, length - 65557), min(length, 65557))
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    _, _, _, count, size, begin, _ = struct.unpack_from("<4H2IH", tail, at + 4)
    if count == MANY or BIG in (size, begin):
        where = length - len(tail) + at - 20
        locator = read_range(file, where, 20) if where >= 0 else b""
        if locator[:4] != LOCATOR:
            raise ValueError("no ZIP64 locator before the end of central directory")
        end = read_range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end of central directory where the locator points")
        _, count, size, begin = struct.unpack_from("<4Q", end, 24)
    found, raw, at = {}, read_range(file, begin, size), 0
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("the central directory has an entry without its mark")
        _, _, _, method, _, _, _, packed, plain, n, m, k, _, _, _, offset = struct.unpack_from("<6H3I5H2I", raw, at + 4)
        name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<2H", extra)
            if kind == 1:  # ZIP64: those of the three that did not fit, in this order
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                plain, packed, offset = (wide.pop(0) if x == BIG and wide else x for x in (plain, packed, offset))
            extra = extra[4 + width :]
        head = read_range(file, offset, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name}: no local header at {offset}")
        n2, m2 = struct.unpack_from("<2H", head, 26)
        found[name] = (method, offset + 30 + n2 + m2, packed)
        at += 46 + n + m + k
    return found


def stored_member(found: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    if name not in found:
        raise ValueError(f"the archive has no member {name}")
    method, at, size = found[name]
    if method:
        raise ValueError(f"{name} is compressed; ranges can be read from stored members only")
    return at, size


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record without it."""
    mark = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", mark(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        fields += [("WARC-Refers-To", mark(refers_to)), ("WARC-Profile", PROFILE)]
    block = http + (payload if refers_to is None else b"")
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type and refers_to.

    ValueError if the record is cut or its payload does not have its digest.
    """
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("the record is cut")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or sha1(payload).hexdigest() != digest):
        raise ValueError("the payload does not have the record's length and digest")
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("warc-refers-to"))}


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the manifest (archive, records, bytes).

    Of records with equal payloads of at least 1000 bytes the one with the largest
    page_id is a response and the others revisit it; rows that repeat that page_id
    are responses too. A null html is an empty payload. A null page_id is never
    referred to; without others such records are responses. No pages: no archives.
    Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "archives")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    again = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    again = stored(again.where("n > 1 and first is not null").select("digest", "first"), "payloads")
    decided = rows.join(bounded(again), "digest", "left").select("page_id", "url", "html", "digest", "size", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(folder)
        system.create_dir(base, recursive=True)
        out = None

        def finish() -> pa.RecordBatch:
            zipped, stream, name, index = out
            zipped.end()
            zipped.begin(INDEX)
            zipped.write("".join(f"{a} {n}\n" for a, n in index).encode())
            zipped.end()
            zipped.close()
            stream.close()
            system.move(f"{base}/{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [len(index)], "bytes": [zipped.at]})

        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    stream = system.open_output_stream(f"{base}/{name}.part")
                    out = (ZipWriter(stream), stream, name, [])
                    out[0].begin(DATA)
                raw = record(row["page_id"], row["url"], row["html"].encode("utf-8", "replace"), row["digest"], row["size"], row["refers_to"])
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                out[3].append((out[0].members[-1][3], len(packed)))
                out[0].write(packed)
                if out[0].at >= ARCHIVE_BYTES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return stored(decided.mapInArrow(written, "archive string, records long, bytes long"), "manifest")


def ranges(manifest: DataFrame) -> DataFrame:
    """(archive, at, sizes): ranges of consecutive records, from the archives' directories and indexes."""

    def located(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = store(archive)
                with system.open_input_file(path) as file:
                    found = directory(file)
                    data, length = stored_member(found, DATA)
                    entries = [tuple(map(int, x.split())) for x in read_range(file, *stored_member(found, INDEX)).decode().splitlines()]
                if any(a + n > length for a, n in entries):
                    raise ValueError(f"{archive}: its index points beyond its records")
                starts, sizes = [], []
                for at, size in entries:
                    if not sizes or len(sizes[-1]) >= RANGE_RECORDS or sum(sizes[-1]) >= RANGE_BYTES or starts[-1] + sum(sizes[-1]) != data + at:
                        starts.append(data + at)
                        sizes.append([])
                    sizes[-1].append(size)
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.list_(pa.int64()))], ["archive", "at", "sizes"])

    return manifest.select("archive").mapInArrow(located, "archive string, at long, sizes array<long>")


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives of the manifest; without payloads that column is null."""

    def fetched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for batch in batches:
            for row in batch.to_pylist():
                system, path = store(row["archive"])
                with system.open_input_file(path) as file:
                    raw, at, rows = read_range(file, row["at"], sum(row["sizes"])), 0, []
                for size in row["sizes"]:
                    got = parse(raw[at : at + size])
                    rows.append(got if payloads else got | {"payload": None})
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    spread = stored(ranges(manifest), "ranges")
    tasks = max(1, min(4096, spread.count() // 4))
    return spread.repartition(tasks, "archive", "at").mapInArrow(fetched, RECORD)
