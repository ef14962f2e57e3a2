"""WARC archives as a Spark data source, and pages written to and read from them.

`spark.read.format("warc").load(path)` gives the columns of SCHEMA, or those of them that a schema names:
what isn't asked for isn't decoded. Files are the unit of planning: small ones share a partition, and the
writer begins another after `max_file_bytes`. Filters on record_type, target_uri, payload_digest and
refers_to are pushed down (with spark.sql.python.filterPushdown.enabled) and judged on the header, which is
parsed first; a record that fails is passed over by its length, uncompressed, or by the skip length in its
gzip header, without decoding its payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from gridloom.llm.common import arrow_batches, scratch

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, "
    "payload_digest string, payload_bytes long, refers_to string, headers map<string,string>, payload binary"
)
#: Columns that filters can be pushed down on, with the header that each is.
_PUSHED = {"record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: The profile of a revisit that has the same payload, fixed by the WARC 1.1 standard.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Paths may be local, file: or of any store that pyarrow opens (s3, gs, abfs, hdfs)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member of its own, whose extra field `sl` tells its compressed and plain length."""
    packer = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers alone, which still tell the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        # as it is, but for what would end the line or part it
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {IDENTICAL}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Plain:
    """Bytes of the current record, with what lies before the end of the headers at hand."""

    def __init__(self, stream):
        self.stream = io.BufferedReader(stream, 1 << 16)

    def header(self) -> bytes | None:
        lines = []
        while line := self.stream.readline():
            if line.strip():
                lines.append(line)
            elif lines:
                return b"".join(lines)
        return b"".join(lines) or None

    def block(self, size: int) -> bytes:
        return self.stream.read(size)

    def skip(self, size: int) -> None:
        self.stream.seek(size, io.SEEK_CUR)


class _Members:
    """Records that are gzip members each: inflates as far as is asked for, and passes over the rest."""

    def __init__(self, stream):
        self.stream, self.buffer, self.next = stream, b"", 0

    def _more(self) -> bool:
        if self.inflater.eof or self.inflater.needs_input is False:
            return False
        raw = self.inflater.unconsumed_tail or self.stream.read(1 << 14)
        self.buffer += self.inflater.decompress(raw, 1 << 16)
        if self.inflater.eof:
            self.end = self.stream.tell() - len(self.inflater.unused_data)
        return bool(raw)

    def header(self) -> bytes | None:
        self.stream.seek(self.next)
        head = self.stream.read(24)
        if len(head) < 18:
            return None
        self.end = None
        if head[3] & 4 and head[12:14] == b"sl":
            self.end = self.next + struct.unpack("<I", head[16:20])[0]
        known = self.end
        self.stream.seek(self.next)
        self.inflater, self.buffer = _Inflater(), b""
        while (cut := self.buffer.find(b"\r\n\r\n")) < 0 and self._more():
            pass
        self.end = self.end or known
        if cut < 0:
            raise ValueError("a gzip member without a WARC header")
        found, self.buffer = self.buffer[:cut], self.buffer[cut + 4 :]
        return found

    def block(self, size: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < size:
            self.buffer = b""
            if not self._more():
                break
            parts.append(self.buffer)
            have += len(self.buffer)
        found = b"".join(parts)
        self.buffer = found[size:]
        self.skip(0)
        return found[:size]

    def skip(self, size: int) -> None:
        while self.end is None and self._more():
            self.buffer = b""
        self.next = self.end


class _Inflater:
    def __init__(self):
        self.z = zlib.decompressobj(31)
        self.needs_input = None

    def decompress(self, raw: bytes, most: int) -> bytes:
        return self.z.decompress(raw, most)

    unconsumed_tail = property(lambda self: self.z.unconsumed_tail)
    unused_data = property(lambda self: self.z.unused_data)
    eof = property(lambda self: self.z.eof)


def _headers(raw: bytes) -> dict[str, str]:
    found, last = {}, None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return found


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value is not None else None


def records(stream, wanted: list[tuple[str, set]], columns: list[str], verify: bool) -> Iterator[dict]:
    """The records of an archive whose headers pass; only the columns that are asked for are decoded. The stream stays open."""
    magic = stream.read(2)
    stream.seek(0)
    if magic == b"\x1f\x8b":
        yield from _records(_Members(stream), wanted, columns, verify)
        return
    source = _Plain(stream)
    try:
        yield from _records(source, wanted, columns, verify)
    finally:
        source.stream.detach()


def _records(source, wanted: list[tuple[str, set]], columns: list[str], verify: bool) -> Iterator[dict]:
    whole = "payload" in columns or verify
    while (raw := source.header()) is not None:
        h = _headers(raw)
        size = int(h.get("content-length", 0))
        row = {
            "record_id": _bare(h.get("warc-record-id")), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
            "content_type": h.get("content-type"), "content_length": size, "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "refers_to": _bare(h.get("warc-refers-to")), "headers": h, "payload": None, "payload_bytes": None,
        }
        if any(row[name] not in values for name, values in wanted):
            source.skip(size + 4)
            continue
        http = h.get("content-type", "").startswith("application/http")
        if whole or http and "payload_bytes" in columns:
            block = source.block(size)
            if http:
                inner, _, payload = block.partition(b"\r\n\r\n")
                length = _headers(inner).get("content-length")
                row["payload_bytes"] = int(length) if length else len(payload)
            else:
                payload = block
                row["payload_bytes"] = len(block)
            if row["record_type"] != "revisit":
                row["payload"] = payload
                if verify:
                    row["payload_bytes"] = len(payload)
                    if row["payload_digest"] is not None and digest(payload) != row["payload_digest"]:
                        raise ValueError(f"the payload of {row['record_id']} doesn't have the digest that its header tells")
            if isinstance(source, _Plain):
                source.skip(4)
        else:
            row["payload_bytes"] = size
            source.skip(size + 4)
        yield row


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.options, self.wanted = [f.name for f in schema], options, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED and f.value is not None:
                self.wanted.append((f.attribute[0], {f.value}))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.wanted.append((f.attribute[0], set(f.value)))
            else:
                yield f

    def partitions(self):
        store, path = opened(self.options["path"])
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        found = sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith(("_", ".")))
        most, out, size = int(self.options.get("partition_bytes", 32 << 20)), [], 0
        for name, n in found:
            if not out or size + n > most:
                out.append([])
                size = 0
            out[-1].append(name)
            size += n
        return [_Files(x) for x in out] or [_Files([])]

    def read(self, partition):
        store, _ = opened(self.options["path"])
        verify = self.options.get("verify", "false").lower() == "true"
        for path in partition.paths:
            with store.open_input_file(path) as stream:
                for row in records(stream, self.wanted, self.columns, verify):
                    yield tuple(row[c] for c in self.columns)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceWriter):
    """Rows (record_id, record_type, target_uri, date, payload, refers_to); a task's files count once all tasks are done."""

    def __init__(self, options, overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        store, path = opened(self.options["path"])
        store.create_dir(f"{path}/_{self.job}", recursive=True)
        most, files, stream, size = int(self.options.get("max_file_bytes", 256 << 20)), [], None, 0
        try:
            for row in iterator:
                if stream is None or size > most:
                    if stream is not None:
                        stream.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    stream, size = store.open_output_stream(f"{path}/_{self.job}/{files[-1]}", compression=None), 0
                payload = row.payload
                packed = member(record(row.record_type, row.record_id, row.target_uri, row.date, bytes(payload) if payload is not None else b"", row.refers_to))
                stream.write(packed)
                size += len(packed)
        finally:
            if stream is not None:
                stream.close()
        return _Written(files)

    def commit(self, messages):
        store, path = opened(self.options["path"])
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(path)):
                if x.is_file and x.base_name.endswith((".warc", ".warc.gz")):
                    store.delete_file(x.path)
        for message in messages:
            for name in message.files if message else []:
                store.move(f"{path}/_{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages):
        store, path = opened(self.options["path"])
        if store.get_file_info(f"{path}/_{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_{self.job}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A record for each row of pages (page_id, url, html): the last page of equal payloads responds, others revisit it.

    A null html is an empty payload. Payloads under `least_bytes` are all responses; so are rows that repeat
    the last page_id of their payload, and pages without an id whose payload no page with one has.
    Only (digest, id) is grouped, reduced before the shuffle, and only groups of several rows are joined back.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload"), F.concat(F.sha1(html), F.octet_length(html)).alias("same"))
    last = rows.groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("same", "last")
    rows = rows.join(last, "same", "left")
    revisits = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")) & (F.octet_length("payload") >= least_bytes)
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return rows.select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.lit(date).alias("date"), "payload", F.when(revisits, urn(F.col("last"))).alias("refers_to"),
    )


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes the records of pages to WARC files under `path`."""
    register(pages.sparkSession)
    page_records(pages, least_bytes).write.format("warc").mode("append").option("path", path).save()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of the pages in archives.

    Responses are decoded and held against their digest. Revisits are chosen by their headers; of them only
    the HTTP headers are read.
    """
    register(spark)
    wanted = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string"
    read = lambda kind, verify: spark.read.format("warc").schema(wanted).option("verify", verify).load(path).where(F.col("record_type") == kind)
    page = lambda c: F.expr(f"cast(nullif(substring({c}, {len('urn:x-page:') + 1}), '') as long)")
    both = read("response", "true").unionByName(read("revisit", "false"))
    return both.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))


def through_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back; an empty table comes back empty."""
    spark = pages.sparkSession
    arrow_batches(spark)
    path = scratch(spark)
    archive(pages, path, least_bytes)
    return read_pages(spark, path)
