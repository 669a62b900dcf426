"""Legacy web archives (ARC versions 1 and 2) and their conversion to WARC 1.1.

Archive files are written by Spark tasks to a folder all executors share, one gzip member per
record. A task names its files anew on every attempt and returns them as rows of a manifest
table; only files of the committed manifest are read, so lost and repeated attempts do no harm.

The converter reads each ARC file's version block, parses header lines by that version, cuts
records by their declared lengths, and synthesises WARC record ids, dates, types and digests.
Payloads that occur more than once become one response and revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from harvestline.llm.common import prepared, scratch_path, stored

LEVEL = 3                    # gzip level of records
ROLL = 256 << 20             # bytes after which a task starts another file
MIN_REVISIT = 1000           # payload bytes from which equal payloads become revisits
ARCHIVE_DATE = "20240101000000"
MANIFEST = "path string, version int, records long, bytes long"
# Field names of a version's header lines, as its version block lists them (fixed values).
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Writer:
    """One task's archive files below ``folder``; rolls to another file at ``ROLL`` bytes."""

    def __init__(self, folder: str, suffix: str, preamble, version: int = 0):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.folder, self.suffix, self.preamble, self.version = folder, suffix, preamble, version
        self.out, self.done = None, []

    def add(self, record: bytes) -> int:
        """Writes a record and returns its offset."""
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.out, self.size, self.records = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), 0, 0
            self._put(self.preamble(self.name))
        at = self.size
        self._put(record)
        self.records += 1
        if self.size >= ROLL:
            self.close()
        return at

    def _put(self, record: bytes) -> None:
        data = member(record)
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.version, self.records, self.size))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        columns = list(zip(*self.done)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                          names=["path", "version", "records", "bytes"])


def open_file(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def read_member(source, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at an offset, and the offset behind it."""
    z, out = zlib.decompressobj(31), []
    source.seek(at)
    size = at
    while not z.eof:
        chunk = source.read(1 << 16)
        if not chunk:
            raise ValueError(f"archive record at {at} is cut short")
        out.append(z.decompress(chunk))
        size += len(chunk)
    return b"".join(out), size - len(z.unused_data)


def members(path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member of a file."""
    with open_file(path) as source:
        at, end = 0, source.size()
        while at < end:
            data, behind = read_member(source, at)
            yield at, data
            at = behind


# ---- ARC

def http_block(page_id: int | None, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    head += f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return head.encode() + b"\r\n" + payload


def arc_preamble(version: int):
    def block(name: str) -> bytes:
        body = f"{version} 0 harvestline\n{FIELDS[version]}\n\n".encode()
        tail = "" if version == 1 else f" 200 - - 0 {name}"
        return f"filedesc://{name} 0.0.0.0 {ARCHIVE_DATE} text/plain{tail} {len(body)}\n".encode() + body + b"\n"
    return block


def arc_record(version: int, url: str | None, block: bytes, name: str) -> bytes:
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:none"
    fields = [clean, "0.0.0.0", ARCHIVE_DATE, "text/html"]
    if version == 2:
        fields += ["200", hashlib.md5(block).hexdigest(), "-", "0", name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_version(first: bytes) -> int:
    """Version of a file from its first record; its second line starts with the number."""
    lines = first.split(b"\n", 2)
    if not lines[0].startswith(b"filedesc://") or len(lines) < 2 or lines[1].split(b" ")[0] not in (b"1", b"2"):
        raise ValueError("no ARC version block")
    return int(lines[1].split(b" ")[0])


def parse_arc(version: int, data: bytes) -> tuple[dict, bytes]:
    """Header fields and the block of declared length. A content type may hold spaces: fields
    before it are counted from the left, those after it from the right."""
    line, _, rest = data.lstrip(b"\n").partition(b"\n")
    parts = line.decode("utf-8", "replace").split(" ")
    behind = 1 if version == 1 else 6
    if len(parts) < 4 + behind or not parts[-1].isdigit():
        raise ValueError(f"no ARC version {version} header line: {line[:80]!r}")
    length = int(parts[-1])
    if len(rest) < length:
        raise ValueError(f"ARC record declares {length} bytes and has {len(rest)}")
    return {"url": parts[0], "ip": parts[1], "date": parts[2], "type": " ".join(parts[3:len(parts) - behind])}, rest[:length]


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Manifest of ARC files with one record per row of ``pages`` (page_id, url, html); every
    second task writes version 2. Null html is an empty payload, a null url ``urn:none``, a null
    page_id leaves its header out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        writer = Writer(folder, ".arc.gz", arc_preamble(version), version)
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(arc_record(version, url, http_block(page_id, (html or "").encode()), getattr(writer, "name", "-")))
        yield writer.manifest()

    return stored(prepared(pages, "page_id", "url", "html").mapInArrow(run, MANIFEST), "arc-manifest")


# ---- WARC

def split_http(block: bytes) -> tuple[bytes, bytes, int | None, int | None]:
    """Header, payload, page id and declared payload length of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    page = re.search(rb"(?im)^X-Page-Id: *(-?\d+)", head)
    length = re.search(rb"(?im)^Content-Length: *(\d+)", head)
    return head + b"\r\n\r\n", payload, int(page[1]) if page else None, int(length[1]) if length else None


def b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def iso(date: str) -> str:
    d = (date + "00000000000000")[:14] if date.isdigit() else ARCHIVE_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def warc_record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers.items() if v is not None],
             f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    return warc_record("warcinfo", {"WARC-Record-ID": record_id(name), "WARC-Date": iso(ARCHIVE_DATE), "WARC-Filename": name,
                                    "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError(f"WARC record declares {length} bytes and has {len(rest)}")
    return headers, rest[:length]


def arc_index(manifest: DataFrame) -> DataFrame:
    """One row per ARC record: where it is, what it holds, and the id its WARC record gets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, version = [], 0
                for at, data in members(path):
                    if not version:
                        version = arc_version(data)
                        continue
                    fields, block = parse_arc(version, data)
                    _, payload, page_id, _ = split_http(block)
                    digest = hashlib.sha1(payload).digest()
                    rows.append((path, version, at, fields["url"], fields["date"], page_id, len(payload), digest,
                                 record_id(path, str(at), fields["url"], fields["date"])))
                    if len(rows) == 2000:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    names = ["path", "version", "at", "url", "date", "page_id", "payload_bytes", "digest", "record_id"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], names=names)

    schema = "path string, version int, at long, url string, date string, page_id long, payload_bytes long, digest binary, record_id string"
    return stored(spread(manifest).mapInArrow(run, schema), "arc-index")


def spread(manifest: DataFrame) -> DataFrame:
    """The files of a manifest, each its own row, dealt over the tasks."""
    files = manifest.select("path")
    return prepared(files, "path").repartition(max(1, files.count()), "path")


def convert(manifest: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Manifest of WARC files made of the ARC files of ``manifest``. Of records with equal
    payloads of at least ``min_revisit`` bytes, the one with the largest page id (of equal ones
    the largest record id) is the response; the others are revisits of it."""
    index = arc_index(manifest)
    first = index.where(F.col("payload_bytes") >= min_revisit).groupBy("digest").agg(
        F.max(F.struct("page_id", "record_id", "url", "date")).alias("first"), F.count("*").alias("n")).where("n > 1")
    roles = index.join(first.withColumnRenamed("digest", "first_digest"),
                       (F.col("digest") == F.col("first_digest")) & (F.col("payload_bytes") >= min_revisit), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    roles = roles.select("path", "at", "version", "record_id", "digest", *[
        F.when(revisit, F.col(f"first.{c}")).alias(f"to_{c}") for c in ("record_id", "url", "date")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, source, current = Writer(folder, ".warc.gz", warcinfo), None, None
        for batch in batches:
            for path, at, version, own, digest, to_id, to_url, to_date in zip(*(c.to_pylist() for c in batch.columns)):
                if path != current:
                    if source is not None:
                        source.close()
                    source, current = open_file(path), path
                fields, block = parse_arc(version, read_member(source, at)[0])
                headers = {"WARC-Record-ID": own, "WARC-Date": iso(fields["date"]), "WARC-Target-URI": fields["url"],
                           "WARC-IP-Address": fields["ip"], "WARC-Payload-Digest": b32(digest), "Content-Type": "application/http; msgtype=response"}
                if to_id is None:
                    writer.add(warc_record("response", headers, block))
                else:
                    headers |= {"WARC-Refers-To": to_id, "WARC-Refers-To-Target-URI": to_url, "WARC-Refers-To-Date": iso(to_date),
                                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    writer.add(warc_record("revisit", headers, split_http(block)[0]))
        if source is not None:
            source.close()
        yield writer.manifest()

    # ranges of one file stay together and in order; a large file is cut between tasks
    placed = roles.repartitionByRange("path", "at").sortWithinPartitions("path", "at")
    return stored(placed.mapInArrow(run, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row per response or revisit record: record_id, url, date, type, page_id, payload length
    and digest (of the payload a revisit stands for), the record it refers to, and the payload of
    responses. A response whose payload does not have its declared digest is an error."""
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    names = ["record_id", "url", "date", "record_type", "page_id", "payload_bytes", "payload_digest", "refers_to_id", "payload"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for _, data in members(path):
                    headers, block = parse_warc(data)
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    _, payload, page_id, length = split_http(block)
                    digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2])
                    if kind == "response" and hashlib.sha1(payload).digest() != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
                    rows.append((headers["warc-record-id"], headers["warc-target-uri"], headers["warc-date"], kind, page_id,
                                 length if kind == "revisit" else len(payload), digest.hex(), headers.get("warc-refers-to"),
                                 payload if kind == "response" else None))
                    held += len(payload)
                    if held > 1 << 24 or len(rows) == 2000:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    schema = ("record_id string, url string, date string, record_type string, page_id long, payload_bytes long, "
              "payload_digest string, refers_to_id string, payload binary")
    return spread(manifest).mapInArrow(run, schema)


def archived(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes ``pages`` as ARC, converts to WARC, and reads the WARC files back. An empty table
    gives no records; repeated rows become records of their own."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "archives")
    return read_warc(convert(write_arc(pages, f"{folder}/arc"), f"{folder}/warc", min_revisit))
