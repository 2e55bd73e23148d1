"""WARC records in ZIP-packaged archives: written as stored members with an index, read back by range without extraction."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, joined, lean, materialise, shared_folder, small_batches, table

#: An archive is closed once its records hold so many bytes; one record never spans two archives.
ARCHIVE_BYTES = 64 << 20
#: Records that follow each other are read by one range of at most so many bytes, if no single one has more.
RANGE_BYTES = 4 << 20
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format: signatures of the end record, the ZIP64 locator and end record, central and local headers.
_END, _LOCATOR, _END64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header_at: int


class ZipArchive:
    """A ZIP archive of which only the directory and asked-for ranges are read.

    read_at(offset, length) gives bytes of the archive; size is its length. Plain and ZIP64 directories are understood.
    """

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        tail_at = max(0, size - 65557)
        tail = bytes(read_at(tail_at, size - tail_at))
        end = tail.rfind(_END)
        if end < 0:
            raise ValueError("not a ZIP archive: it has no end record")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        at = tail_at + end
        if at >= 20 and bytes(read_at(at - 20, 4)) == _LOCATOR:
            (end64,) = struct.unpack("<Q", read_at(at - 12, 8))
            if bytes(read_at(end64, 4)) != _END64:
                raise ValueError("the ZIP64 locator points at no end record")
            count, length, start = struct.unpack("<QQQ", read_at(end64 + 32, 24))
        self.members = {m.name: m for m in self._directory(bytes(read_at(start, length)), count)}

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != _CENTRAL:
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            stored, size, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
            (header_at,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while k + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, k)
                if kind == 1:  # 64-bit values, only of the fields that overflow, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    stored = next(wide) if stored == 0xFFFFFFFF else stored
                    header_at = next(wide) if header_at == 0xFFFFFFFF else header_at
                k += 4 + n
            yield Member(name, method, size, stored, header_at)
            at += 46 + n_name + n_extra + n_note

    def data_at(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members are range-read")
        head = bytes(self.read_at(m.header_at, 30))
        if head[:4] != _LOCAL:
            raise ValueError(f"{name} has no local header where the directory says")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return m.header_at + 30 + n_name + n_extra

    def read(self, name: str) -> bytes:
        return bytes(self.read_at(self.data_at(name), self.members[name].size))


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _urn(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: object, url: str | None, payload: bytes, refers_to: object | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers, which tell the payload's length, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (lower-case names), HTTP header block and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and its own name for it."""
    return pafs.FileSystem.from_uri(re.sub("^file:/*", "/", path))


class ArchiveWriter:
    """Writes records to one archive as they come: a stored WARC member, then a stored index of lines
    `page_id {filename, offset, length}`."""

    def __init__(self, out):
        self.zip, self.index, self.at = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True), [], 0
        self.warc = self.zip.open(zipfile.ZipInfo(WARC_MEMBER, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)

    def add(self, *args) -> None:
        packed = zlib.compressobj(1, zlib.DEFLATED, 31)  # each record is compressed by itself, the member is stored
        raw, name = packed.compress(record(*args)) + packed.flush(), WARC_MEMBER.partition("/")[2]
        self.index.append(f"{'-' if args[0] is None else args[0]} {json.dumps({'filename': name, 'offset': self.at, 'length': len(raw)})}\n")
        self.warc.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        self.warc.close()
        for name, data in ((INDEX_MEMBER, "".join(self.index).encode()), ("datapackage.json", b'{"profile": "data-package"}')):
            self.zip.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
        self.zip.close()


def record_ranges(archive: ZipArchive) -> Iterator[list[tuple[int, int]]]:
    """(offset in the archive, length) of every indexed record, in lists of records that one read of RANGE_BYTES gives.

    Every member under indexes/ is read; a line names the WARC member of its record, or there is only one. A WARC
    member that no index names raises.
    """
    warcs = {n.partition("/")[2]: n for n in archive.members if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))}
    found: dict[str, list[tuple[int, int]]] = {}
    for name in sorted(n for n in archive.members if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx"))):
        for line in archive.read(name).decode().splitlines():
            if "{" not in line:
                continue
            where = json.loads(line[line.index("{") :])
            member = where.get("filename") or (next(iter(warcs)) if len(warcs) == 1 else None)
            if member not in warcs:
                raise ValueError(f"an index line names no WARC member of the archive: {line[:200]}")
            found.setdefault(member, []).append((int(where["offset"]), int(where["length"])))
    for member, name in warcs.items():
        if archive.members[name].size and member not in found:
            raise ValueError(f"no index covers {name}")
        base, held = archive.data_at(name), []
        for offset, length in sorted(found.get(member, [])):
            if offset < 0 or length < 0 or offset + length > archive.members[name].size:
                raise ValueError(f"an index line points beyond the end of {name}")
            if held and base + offset + length - held[0][0] > RANGE_BYTES:
                yield held
                held = []
            held.append((base + offset, length))
        if held:
            yield held


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least least_bytes, all but that of the largest id refer to it."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"_sha1": F.sha1("payload"), "_n": F.octet_length("payload")})
    largest = materialise(rows.groupBy("_sha1", "_n").agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_rows")))
    other = (F.col("_n") >= least_bytes) & F.col("_largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_largest"))
    return joined(rows, largest, ["_sha1", "_n"], "_rows", F.col("page_id")).select("page_id", "url", "payload", F.when(other, F.col("_largest")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """(path, length) of ZIP archives of about ARCHIVE_BYTES of WARC records, written to the folder, which all executors
    share, by each task as its rows come. A file that a failed attempt leaves behind is named by no row."""
    small_batches(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file_system(folder)
        store.create_dir(base, recursive=True)
        writer = None

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([store.get_file_info(f"{base}/{name}").size])], ["path", "length"])

        for b in batches:
            for page_id, url, payload, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{base}/{name}")
                    writer = ArchiveWriter(out)
                writer.add(page_id, url, payload, refers_to)
                if writer.at >= ARCHIVE_BYTES:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return materialise(records.select("page_id", "url", "payload", "refers_to").mapInArrow(lean(write), "path string, length long"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For archives (path, length): which ranges hold which records. Only directories and indexes are read."""
    for b in batches:
        for path, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
            store, name = _file_system(path)
            with store.open_input_file(name) as f:
                parts = list(record_ranges(ZipArchive(lambda at, n, f=f: f.read_at(n, at), length)))
            for k in range(0, len(parts), 256):
                some = parts[k : k + 256]
                at, n = ([[x[i] for x in p] for p in some] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(at, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64()))], ["path", "at", "n"])


_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of ranges, each range by one read."""
    opened: tuple = (None, None)
    for b in batches:
        for path, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if opened[0] != path:
                store, name = _file_system(path)
                opened = path, store.open_input_file(name)
            raw, rows = opened[1].read_at(max(a + m for a, m in zip(at, n, strict=True)) - at[0], at[0]), []
            for a, m in zip(at, n, strict=True):
                one = raw[a - at[0] : a - at[0] + m]
                headers, http, payload = parse_record(zlib.decompress(one, 31) if one[:2] == b"\x1f\x8b" else one)
                digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"payload digest of {headers['warc-record-id']} does not match")
                length = int(re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)[1])
                rows.append((headers.get("page-id"), headers.get("warc-target-uri"), length, digest, kind, headers.get("refers-to-page-id"), payload if kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record of archives (path, length).

    Directories and indexes are read first; the ranges that hold records are then dealt over all tasks, so one large
    archive is read by many. Responses carry their payload, whose digest is computed anew and must match the header;
    revisits carry none, and their length comes from the kept HTTP headers. An archive without records gives no rows; a
    damaged one raises.
    """
    small_batches(archives.sparkSession)
    found = archives.select("path", "length").mapInArrow(lean(_ranges), "path string, at array<long>, n array<long>")
    dealt = found.repartition("path", F.col("at")[0])
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    return dealt.mapInArrow(lean(_records), schema)


def read_archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archive files of a folder or pattern. Spark lists them; no file is read as a whole."""
    return read_archives(spark.read.format("binaryFile").load(path).select("path", "length"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back by range, one row per page without its payload.

    Null html is an empty payload and takes part as any other. A null page_id is kept as null; rows that repeat the
    largest id of their group are all responses. An empty table gives no archives and no rows; extra columns are not read.
    """
    folder = f"{shared_folder(pages.sparkSession)}/gridloom-{uuid.uuid4().hex}"
    back = read_archives(write_archives(with_revisits(pages, least_bytes), folder))
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
QUERIES = {"op9_warc": op9_warc}
SQL = {
    "op9_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM m
"""
}
