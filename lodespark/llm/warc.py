"""WARC archives as a Spark data source, and an operator that archives pages and reads them back.

``spark.read.format("warc").load(folder)`` plans one partition for each archive file that a finished write (or the
folder's listing) names. Record type, digest, target and record id are pushed down: a record's header is inflated and
looked at first, and a payload that is not wanted is stepped over by the length in the gzip member's ``sl`` field
(inflated and dropped where a foreign file has no such field). Option ``payload=false`` skips every payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from lodespark.llm.common import fresh_dir

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, headers map<string,string>, payload binary"
MANIFEST = "_records.json"
#: Columns that a header alone decides, and the header each comes from.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
READ_AHEAD = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(path: str):
    """pyarrow's file system for a path or URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """A header value in one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, with its compressed and plain lengths in the ``sl`` field."""
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers)
    data = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    c = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    total = 10 + 2 + 12 + len(body) + 8
    sizes = struct.pack("<II", total, len(data)) if max(total, len(data)) < 1 << 32 else struct.pack("<II", 0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sH", 12, b"sl", 8) + sizes + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_header(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continuation lines are joined."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()
    if not lines or not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[:1]}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()}


class ArchiveFile:
    """The records of one archive file, plain or with a gzip member for each record."""

    def __init__(self, path: str):
        fs, at = _file_system(path)
        self.file, self.low, self.buffer = fs.open_input_file(at), 0, b""
        self.size = self.file.size()
        self.inflated = 0  # bytes of payload that were decoded, for tests

    def _at(self, pos: int, n: int) -> bytes:
        if pos < self.low or pos + n > self.low + len(self.buffer):
            self.low, self.buffer = pos, self.file.read_at(min(max(n, READ_AHEAD), self.size - pos), pos)
        return self.buffer[pos - self.low : pos - self.low + n]

    def records(self, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(header, block) of the records whose header is wanted; block is None unless payloads are asked for."""
        pos = 0
        while pos < self.size:
            start = self._at(pos, min(24, self.size - pos))
            if start[:2] == b"\x1f\x8b":
                pos = yield from self._member(pos, start, wanted, payloads)
            elif start[:2] in (b"\r\n", b"\n"):
                pos += 2 if start[:1] == b"\r" else 1
            else:
                pos = yield from self._plain(pos, wanted, payloads)
        self.file.close()

    def _plain(self, pos: int, wanted, payloads: bool):
        n = 4096
        while (end := (head := self._at(pos, min(n, self.size - pos))).find(b"\r\n\r\n")) < 0:
            if n >= self.size - pos:
                raise ValueError(f"a record's header does not end, at byte {pos}")
            n *= 2
        header = parse_header(head[:end])
        length = int(header.get("content-length", 0))
        if wanted(header):
            block = None
            if payloads:
                block = self._at(pos + end + 4, length)
                self.inflated += length
            yield header, block
        return pos + end + 4 + length

    def _member(self, pos: int, start: bytes, wanted, payloads: bool):
        known = struct.unpack("<I", start[16:20])[0] if start[3] & 4 and start[12:14] == b"sl" and len(start) >= 20 else 0
        inflate, data, fed = zlib.decompressobj(31), b"", 0

        def more(limit: int) -> None:
            nonlocal data, fed
            chunk = inflate.unconsumed_tail
            if not chunk:
                chunk = self._at(pos + fed, min(16384, (known or self.size - pos) - fed))
                if not chunk:
                    raise ValueError(f"a record ends too early, at byte {pos}")
                fed += len(chunk)
            data += inflate.decompress(chunk, limit)

        while (end := data.find(b"\r\n\r\n")) < 0 and not inflate.eof:
            more(2048)
        header = parse_header(data[:end] if end >= 0 else data)
        take = wanted(header)
        if take and payloads or not known:
            need = end + 4 + int(header.get("content-length", 0))
            pieces, size = [data], len(data)
            while not inflate.eof:
                data = b""
                more(1 << 20)
                size += len(data)
                if take and payloads:
                    pieces.append(data)
            self.inflated += size - end - 4
            used = fed - len(inflate.unused_data)
            if take:
                block = None
                if payloads:
                    block = b"".join(pieces)[end + 4 : need]
                    if len(block) < need - end - 4:
                        raise ValueError(f"a record ends too early, at byte {pos}")
                yield header, block
            return pos + (known or used)
        if take:
            yield header, None
        return pos + known


def payload_of(header: dict[str, str], block: bytes | None) -> bytes | None:
    """The payload: for HTTP records what follows the HTTP header, for others the whole block; None for revisits."""
    if block is None or header.get("warc-type") == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if header.get("content-type", "").startswith("application/http") else block


@dataclass
class Archive(InputPartition):
    path: str | None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in HEADER_OF and isinstance(f, EqualTo):
                self.tests.append((HEADER_OF[column], [f.value]))
            elif column in HEADER_OF and isinstance(f, In):
                self.tests.append((HEADER_OF[column], list(f.value)))
            elif column in HEADER_OF and isinstance(f, IsNotNull):
                self.tests.append((HEADER_OF[column], []))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """One partition for each archive; files of writes that did not finish are in no manifest."""
        from pyarrow import fs as pfs

        fs, at = _file_system(self.path)
        if fs.get_file_info(at).type == pfs.FileType.File:
            return [Archive(self.path)]
        found = sorted(x.base_name for x in fs.get_file_info(pfs.FileSelector(at)))
        if manifests := [n for n in found if n.startswith(MANIFEST)]:
            names = []
            for n in manifests:
                with fs.open_input_file(f"{at}/{n}") as f:
                    names += json.loads(f.read())
        else:
            names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
        return [Archive(f"{self.path.rstrip('/')}/{n}") for n in names] or [Archive(None)]

    def _wanted(self, header: dict[str, str]) -> bool:
        return all(k in header and (not values or _value(k, header[k]) in values) for k, values in self.tests)

    def read(self, partition: Archive) -> Iterator[tuple]:
        if partition.path is None:
            return
        for h, block in ArchiveFile(partition.path).records(self._wanted, self.payloads):
            payload = payload_of(h, block)
            if payload is not None and (want := h.get("warc-payload-digest", "")).startswith("sha1:") and "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != want:
                raise ValueError(f"payload of {h.get('warc-record-id')} does not match its digest")
            size = int(h["x-payload-length"]) if "x-payload-length" in h else None
            yield (*(_value(HEADER_OF[c], h.get(HEADER_OF[c])) for c in ("record_id", "record_type", "target_uri", "payload_digest")), len(payload) if payload is not None else size, _value("warc-refers-to", h.get("warc-refers-to")), h, payload)


def _value(name: str, value: str | None) -> str | None:
    """Record ids without their angle brackets."""
    return value[1:-1] if value and name in ("warc-record-id", "warc-refers-to") and value[0] == "<" else value


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceWriter):
    """Writes rows (record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to, payload).

    Every commit leaves a manifest of its own, so archives of earlier commits stay; an overwrite removes the manifests before it.
    """

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.roll = int(options.get("rollBytes", 256 << 20))

    def write(self, rows: Iterator[Row]) -> Written:
        fs, at = _file_system(self.path)
        fs.create_dir(at, recursive=True)
        names, out, size = [], None, 0
        for row in rows:
            if out is None or size >= self.roll:
                if out:
                    out.close()
                names.append(f"{uuid.uuid4().hex}.warc.gz")
                out, size = fs.open_output_stream(f"{at}/{names[-1]}", compression=None), 0
            data = _record(row)
            out.write(data)
            size += len(data)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        fs, at = _file_system(self.path)
        fs.create_dir(at, recursive=True)
        before = self._manifests(fs, at) if self.overwrite else []
        with fs.open_output_stream(f"{at}/{MANIFEST}-{uuid.uuid4().hex}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        for n in before:
            fs.delete_file(f"{at}/{n}")

    def _manifests(self, fs, at: str) -> list[str]:
        from pyarrow import fs as pfs

        return [x.base_name for x in fs.get_file_info(pfs.FileSelector(at)) if x.base_name.startswith(MANIFEST)]

    def abort(self, messages: list) -> None:
        fs, at = _file_system(self.path)
        for n in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{at}/{n}")


def _record(row: Row) -> bytes:
    payload = bytes(row.payload or b"")
    headers = [("WARC-Type", row.record_type), ("WARC-Record-ID", f"<{row.record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    headers += [("WARC-Target-URI", row.target_uri)] if row.target_uri else []
    headers += [("WARC-Payload-Digest", row.payload_digest), ("X-Payload-Length", str(row.payload_bytes)), ("Content-Type", "application/http;msgtype=response")]
    if row.record_type == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{row.refers_to}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    return record_bytes(headers, http + payload)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _base32(hexed: F.Column) -> F.Column:
    """Base32 of a hex SHA-1: its 160 bits in groups of five, in the JVM."""
    digit = lambda k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(F.lpad(F.conv(F.substring(hexed, k // 8 * 10 + 1, 10), 16, 2), 40, "0"), k % 8 * 5 + 1, 5), 2, 10).cast("int") + 1, F.lit(1))
    return F.concat(*(digit(k) for k in range(32)))


def archive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = 0) -> DataFrame:
    """Rows for the writer: of equal payloads of at least ``smallest`` bytes the page with the smallest id is the response.

    Payloads are compared by SHA-1 and length. Null payloads are empty. A page with a null id is a response only if no
    other page has its payload; it revisits otherwise. Rows that repeat id and payload are responses both.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    first = rows.where(F.col("payload_bytes") >= smallest).groupBy("digest", "payload_bytes").agg(F.min("id").alias("first"))
    joined = rows.join(first, ["digest", "payload_bytes"], "left")
    response = F.col("id").eqNullSafe(F.col("first")) | F.col("first").isNull()
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        urn(F.col("id")).alias("record_id"),
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        "target_uri",
        F.concat(F.lit("sha1:"), _base32(F.col("digest"))).alias("payload_digest"),
        "payload_bytes",
        F.when(~response, urn(F.col("first"))).alias("refers_to"),
        F.when(response, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = 0) -> DataFrame:
    """Writes a record for every page below ``path`` and returns the records read back from there."""
    spark = pages.sparkSession
    register(spark)
    archive_records(pages, id_col, url_col, payload_col, smallest).write.format("warc").mode("append").save(path)
    return read_warc(spark, path)


def archived(pages: DataFrame, path: str | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every page, from archives in the shared folder."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    records = archive_pages(pages, path or fresh_dir(spark, "warc"), id_col)
    number = lambda c: F.when(F.length(c) > 9, F.substring(c, 10, 40)).cast(kind)
    return records.select(
        number(F.col("record_id")).alias(id_col),
        "payload_bytes",
        F.substring("payload_digest", 6, 32).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
