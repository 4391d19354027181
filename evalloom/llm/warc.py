"""WARC archives: writing, normalising monolithic gzip files, and reading records by offset.

A monolithic archive is one gzip stream over all its records, so no record can be read without inflating
what stands before it. The normaliser inflates such a stream once, writes every record as a gzip member of
its own, and records each member's offset and length in a sidecar index. Files are opened through
``pyarrow.fs``; each is written under a temporary name by one task and then moved, so a task that is
run again replaces its file with the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import text_of
from evalloom.plans.staging import fresh_path, staged

BLOCK = 1 << 20
GZIP = 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_SCHEMA = "path string, records long"
INDEX_SCHEMA = "path string, offset long, length long, record_no long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, verified boolean"


#: Schemes of Spark's connectors and those of ``pyarrow.fs`` for the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def store_uri(uri: str) -> str:
    scheme, mark, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{mark}{rest}"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local (``archive_pages`` puts Spark's default file system before it)."""
    return pafs.FileSystem.from_uri(store_uri(uri)) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and host of Hadoop's default file system (core-site.xml and spark.hadoop settings) where it has none of its own."""
    if ":" in folder.split("/")[0]:
        return folder
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return f"{default.rstrip('/')}{folder}" if "://" in default.rstrip("/") else f"{default.rstrip('/')}//{folder}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: object) -> str:
    """A header value: line breaks would end the header, so they are percent-encoded."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unfield(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    head += [] if url is None else [f"WARC-Target-URI: {_field(url)}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _number(urn: str) -> int | None:
    tail = urn.rstrip(">").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def records_in(stream: BinaryIO) -> Iterator[bytes]:
    """Raw records of a gzip file, inflated once from front to back; holds a record and a block at a time."""
    inflate, held = zlib.decompressobj(GZIP), bytearray()
    need = -1
    while True:
        block = stream.read(BLOCK)
        while block:
            held += inflate.decompress(block)
            block = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(GZIP)
        at = 0
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                length = next(int(x.split(b":", 1)[1]) for x in held[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4 - at
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, -1
        del held[:at]
        if stream.tell() >= stream.size():
            if held:
                raise ValueError(f"the archive ends inside a record ({len(held)} bytes left)")
            return


class _Archive:
    """A file in the shared store that appears under its name once it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = open_store(folder)
        self.uri, self.path = f"{folder}/{name}", f"{root}/{name}"
        self.fs.create_dir(root, recursive=True)
        self.held = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.out, self.records, self.offset = self.fs.open_output_stream(self.held), 0, 0

    def write(self, data: bytes, records: int = 1) -> None:
        self.out.write(data)
        self.offset += len(data)
        self.records += records

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.held, self.path)


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes columns page_id, url, payload (binary), refers_to, revisit as monolithic archives; one row per file.

    Each task writes its own files and starts a new one after ``roll_bytes`` of records.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll, archive, squeeze, raw, done = TaskContext.get().partitionId(), 0, None, None, 0, []
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit")), strict=True):
                if archive is None:
                    archive, squeeze, raw = _Archive(folder, f"mono-{part:06d}-{roll:04d}.warc.gz"), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
                data = record(page_id, url, payload, refers_to, revisit, date)
                archive.write(squeeze.compress(data))
                raw += len(data)
                if raw >= roll_bytes:
                    archive.write(squeeze.flush(), 0)
                    archive.close()
                    done.append((archive.uri, archive.records))
                    archive, roll = None, roll + 1
        if archive is not None:
            archive.write(squeeze.flush(), 0)
            archive.close()
            done.append((archive.uri, archive.records))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return staged(pages.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(write, FILE_SCHEMA), "warc-files")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives (column path) with a member per record; returns and stores the sidecar index.

    For each input one task inflates the stream once and writes ``<name>`` and ``<name>.idx`` (offset, length and
    number of each record, a line each) into ``folder``. The index comes back as rows path, offset, length,
    record_no.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = open_store(uri)
                archive = _Archive(folder, uri.rpartition("/")[2].replace("mono-", "member-"))
                sidecar = _Archive(folder, f"{archive.uri.rpartition('/')[2]}.idx")
                offsets, lengths = [], []
                with fs.open_input_file(path) as stream:
                    for data in records_in(stream):
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = squeeze.compress(data) + squeeze.flush()
                        offsets.append(archive.offset)
                        lengths.append(len(member))
                        sidecar.write(b"%d %d %d\n" % (archive.offset, len(member), archive.records))
                        archive.write(member)
                archive.close()
                sidecar.close()
                n = len(offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive.uri] * n, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(range(n), pa.int64())], ["path", "offset", "length", "record_no"]
                )

    n = max(1, files.count())  # a task for each archive, which adaptive execution does not put together again
    return staged(files.select("path").repartitionByRange(n, "path").mapInArrow(rewrite, INDEX_SCHEMA), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Reads each record of the index by its offset alone; payloads are digested again (``verified``)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            rows = []
            for uri, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if uri != opened[0]:
                    fs, path = open_store(uri)
                    opened = (uri, fs.open_input_file(path))
                opened[1].seek(offset)
                fields, block = parse(zlib.decompress(opened[1].read(length), GZIP))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length")).split(": ")[1])
                digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                url = fields.get("WARC-Target-URI")
                rows.append((_number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _number(fields["WARC-Refers-To"]) if revisit else None, None if url is None else _unfield(url), revisit or (digest_of(payload) == digest and len(payload) == size)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    n = max(1, index.select("path").distinct().count())
    return index.repartitionByRange(n, "path", "record_no").sortWithinPartitions("path", "record_no").mapInArrow(read, RECORD_SCHEMA)


def plan_records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_bytes: int = 0, max_broadcast: int = 1_000_000) -> DataFrame:
    """Rows for ``write_archives``: of equal payloads of ``min_bytes`` at least, all but the largest id are revisits.

    Payloads that stand once need no partner. Only digests, sizes and identifiers are shuffled to find those that stand more often; their largest identifiers are
    broadcast while there are at most ``max_broadcast``, so that payloads stay where they are read, and joined otherwise.
    """
    body = text_of(html_column).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), body.alias("payload"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("size"))
    groups = rows.select("sha1", "size", "page_id").where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    kept = staged(groups.where("n > 1").drop("n"), "payload-groups")
    kept = F.broadcast(kept) if kept.limit(max_broadcast + 1).count() <= max_broadcast else kept
    same = F.col("first_id").isNull() | F.col("page_id").isNull() | (F.col("page_id") == F.col("first_id"))
    return rows.join(kept, ["sha1", "size"], "left").select("page_id", "url", "payload", F.when(~same, F.col("first_id")).alias("refers_to"), (~same).alias("revisit"))


def delete_archives(files: DataFrame) -> None:
    """Deletes the files listed in column path, each from a task."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = open_store(uri)
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)
            yield batch.select(["path"])

    files.select("path").mapInArrow(remove, "path string").count()


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 0, roll_bytes: int = 256 << 20) -> DataFrame:
    """Writes ``pages`` to archives, normalises them, reads them back: one row per page.

    Columns: page_id, payload_bytes, payload_digest (base32 SHA-1 of the whole payload), record_type,
    refers_to, url, verified. Null html is an empty payload; a null page_id is always a response, as is every row
    that repeats the largest id of its payload. A null url is left out of the record. An empty table writes
    no file and gives an empty result. The monolithic files are deleted once their rewrite is whole.
    """
    folder = qualified(spark, folder or fresh_path(spark, "warc"))
    files = write_archives(plan_records(pages, min_bytes=min_bytes), f"{folder}/mono", roll_bytes)
    index = normalise(files, f"{folder}/members")
    delete_archives(files)
    return read_records(index)
