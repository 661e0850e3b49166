"""WARC records in ZIP archives, read back by byte ranges.

Writing: each page is a WARC record. Of pages with equal payloads the one with the
largest id is the response, the others are revisits that hold headers only. Records are
packed, inside the tasks that read them, into archive files of about ``ARCHIVE_BYTES`` in
the shared folder, with stored (uncompressed) members: the WARC file, its index (page id,
offset, length) and a manifest. A task gives its files names of their own; the table of the
archives (path, bytes) names those of the tasks that succeeded, so a task that was lost and
run again leaves a file that nothing reads.

Reading: an archive file is opened where it lies and only ranges of it are read: its end
for the end record, the ZIP64 end record behind its locator and the central directory
(with ZIP64 extra fields); the local header of a stored member, which gives the place of its
bytes; the index; and the records, neighbours in reads of about ``READ_BYTES``. No member
is extracted. Compressed or encrypted members are refused with a ValueError that names them.
Folders are reached by Arrow's file systems (local and mounted folders, HDFS, S3, GCS).

A null html is an empty payload, a null url gives no target header. Repeated rows with
the largest id are all responses; a null id counts as the smallest and refers like any
other. A page longer than ``ARCHIVE_BYTES`` has an archive of its own, which its task holds
in memory. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize, own_dir
from .common import base32_sha1, slices

ARCHIVE_BYTES, READ_BYTES, TASK_BYTES = 4 << 20, 1 << 20, 64 << 20
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DATE = "2024-01-01T00:00:00Z"


class Ranges:
    """Reads of byte ranges of one archive, with a count of what was read."""

    def __init__(self, source: pa.NativeFile | bytes):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        self.size, self.touched = self.source.size(), 0

    def get(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError("a range lies outside the archive")
        self.touched += length
        return self.source.read_at(length, offset)


def file_system(path: str) -> tuple[pa_fs.FileSystem, str]:
    """Arrow's file system of a folder or file, and the path in it."""
    return pa_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def build_zip(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """An archive of stored members. ``zip64``: sizes and offsets in ZIP64 records, as a
    large archive needs them."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at, n = name.encode(), zlib.crc32(data), len(out), len(data)
        wide = 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, n, n) if zip64 else b""
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, wide if zip64 else n, wide if zip64 else n, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if zip64 else b""
        central += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, wide if zip64 else n, wide if zip64 else n, len(raw), len(extra), 0, 0, 0, 0, wide if zip64 else at) + raw + extra
    at, n = len(out), len(members)
    out += central
    if zip64:
        here = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), at)
        out += LOCATOR64 + struct.pack("<IQI", 0, here, 1)
        out += END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        out += END + struct.pack("<HHHHIIH", 0, 0, n, n, len(central), at, 0)
    return bytes(out)


def directory(r: Ranges) -> dict[str, tuple[int, int, int]]:
    """``name -> (local header offset, stored size, crc)`` from the central directory."""
    end = None
    for reach in (4096, 65557):  # the comment of an archive may be long
        first = max(0, r.size - reach)
        tail = r.get(first, r.size - first)
        at = tail.rfind(END)
        while at >= 0 and end is None:
            # a record, not a comment's bytes: its comment ends with the archive
            if at + 22 <= len(tail) and at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] == len(tail):
                end = first + at
            at = tail.rfind(END, 0, at + 3) if at else -1
        if end is not None or not first:
            break
    if end is None:
        raise ValueError("no end record: not a ZIP archive")
    _, _, _, count, size, start, _ = struct.unpack("<HHHHIIH", r.get(end + 4, 18))
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        locator = r.get(end - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("the ZIP64 locator is missing")
        at64 = struct.unpack("<IQI", locator[4:])[1]
        record = r.get(at64, 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 end record is missing")
        _, _, _, _, _, _, count, size, start = struct.unpack("<QHHIIQQQQ", record[4:])
    raw, found, i = r.get(start, size), {}, 0
    for _ in range(count):
        if raw[i : i + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        _, _, flags, method, _, _, crc, packed, plain, n, m, k, _, _, _, offset = struct.unpack("<HHHHHHIIIHHHHHII", raw[i + 4 : i + 46])
        name = raw[i + 46 : i + 46 + n].decode("utf-8", "replace")
        extra, j = raw[i + 46 + n : i + 46 + n + m], 0
        while j + 4 <= len(extra):
            tag, length = struct.unpack("<HH", extra[j : j + 4])
            if tag == 1:  # only the fields that overflow, in this order
                wide = iter(struct.unpack(f"<{length // 8}Q", extra[j + 4 : j + 4 + length // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            j += 4 + length
        if method or flags & 1:
            raise ValueError(f"{name} is compressed or encrypted, not stored")
        found[name] = (offset, plain, crc)
        i += 46 + n + m + k
    return found


def member_at(r: Ranges, offset: int) -> int:
    """Where a stored member's bytes start, from its local header."""
    head = r.get(offset, 30)
    if head[:4] != LOCAL:
        raise ValueError("a local header is missing")
    n, m = struct.unpack("<HH", head[26:30])
    return offset + 30 + n + m


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with ``refers_to`` a revisit that leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    number = lambda k: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", field.get(k, ""))) else None
    kind = field["warc-type"]
    said = field["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(body) != length or base32_sha1(body) != said):
        raise ValueError("a payload differs from its digest")
    return {"page_id": number("warc-record-id"), "url": field.get("warc-target-uri"), "payload_bytes": length, "payload_digest": said, "record_type": kind, "refers_to": number("warc-refers-to"), "payload": body if kind == "response" else None}


def build_archive(records: list[tuple[int | None, bytes]], zip64: bool = True) -> bytes:
    """WARC file, index and manifest in one archive."""
    index, at = [], 0
    for page_id, raw in records:
        index.append(f"{'' if page_id is None else page_id} {at} {len(raw)}")
        at += len(raw)
    manifest = '{"profile": "data-package", "resources": ["archive/data.warc", "indexes/index.txt"]}'
    return build_zip([("archive/data.warc", b"".join(r for _, r in records)), ("indexes/index.txt", "\n".join(index).encode()), ("datapackage.json", manifest.encode())], zip64)


def read_archive(source: pa.NativeFile | bytes | Ranges, only: set[int] | None = None) -> Iterator[dict]:
    """The records of an archive, or those of the pages ``only``. Records that follow each
    other are read together, up to ``READ_BYTES``."""
    r = source if isinstance(source, Ranges) else Ranges(source)
    found = directory(r)
    index_at, size, crc = found["indexes/index.txt"]
    index = r.get(member_at(r, index_at), size)
    if zlib.crc32(index) != crc:
        raise ValueError("the index is damaged")
    base = member_at(r, found["archive/data.warc"][0])
    wanted = []
    for line in index.decode().split("\n"):
        if line:
            page, offset, length = line.split(" ")
            if only is None or (page and int(page) in only):
                wanted.append((int(offset), int(length)))
    first = 0
    while first < len(wanted):
        last, start = first, wanted[first][0]
        while last + 1 < len(wanted) and wanted[last + 1][0] == sum(wanted[last]) and sum(wanted[last + 1]) - start <= READ_BYTES:
            last += 1
        read = r.get(base + start, sum(wanted[last]) - start)
        for offset, length in wanted[first : last + 1]:
            yield parse_record(read[offset - start : offset - start + length])
        first = last + 1


def with_references(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: the largest id with an equal payload, null for
    that page itself and for payloads below ``min_revisit_bytes``. The grouping moves
    digests only. The table of repeated digests is written, so that its size is known: Spark
    broadcasts it below its own bound, and beyond it joins by digest, where adaptive
    execution splits a hot payload."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.unhex(F.sha2("html", 256)))
    top = p.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1")
    top = materialize(top.select(F.concat(F.col("digest"), F.lit(b"")).alias("d2"), "top"))
    joined = p.join(top, F.concat(p["digest"], F.lit(b"")) == F.col("d2"), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = True, **columns) -> DataFrame:
    """Writes archive files below ``path`` and returns the table of them: ``path, bytes``."""

    def run(batches):
        fs, folder = file_system(path)
        fs.create_dir(f"{folder}/archives")
        held, size = [], 0

        def flush():
            name, data = f"archives/{uuid.uuid4().hex}.wacz", build_archive(held, zip64)
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "bytes": [len(data)]})

        for piece in slices(batches, "html", archive_bytes):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in piece.columns)):
                raw = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                if held and size + len(raw) > archive_bytes:
                    yield flush()
                    held, size = [], 0
                held.append((page_id, raw))
                size += len(raw)
        if held:
            yield flush()

    spark = pages.sparkSession
    with_references(pages, **columns).mapInArrow(run, "path string, bytes long").write.parquet(f"{path}/table")
    return spark.read.parquet(f"{path}/table")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archive files in a table ``path, bytes``. ``payloads`` off:
    headers and sizes only travel on. Files are dealt so that a task reads about
    ``TASK_BYTES``."""
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(2 * archives.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, file = file_system(name)
                with fs.open_input_file(file) as source:
                    rows, size = [], 0
                    for r in read_archive(source):
                        size += r["payload_bytes"] + 200
                        rows.append(r if payloads else r | {"payload": None})
                        if size > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, RECORD)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archive files of a folder; Spark lists them, their bytes are not loaded."""
    return read_archives(spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes")))


def new_store(spark: SparkSession) -> str:
    return f"{own_dir(spark)}/warc-{uuid.uuid4().hex}"
