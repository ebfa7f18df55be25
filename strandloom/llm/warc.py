"""Operator 7, WARC: write, normalise monolithic gzip, read back.

write_archives: each task writes its rows as WARC files of one gzip stream each (at most ARCHIVE_BYTES of payload unless a
record alone is larger) into the shared folder, and reports their paths. normalise: a file is inflated once, as a stream;
every record is written again as a gzip member of its own, with a sidecar index of offsets. read_records: a file's
members are opened one by one by that index.

A file's name is new for each attempt, and only names that a finished task reports are read, so a lost executor's files
do no harm. Files are opened with pyarrow's filesystems, which know local, HDFS and object-store addresses.

Payloads of at least DEDUP_BYTES that are equal share one response, at the largest page_id; the others are revisits that
carry its id, digest and length. Rows that repeat both page_id and payload of a response are responses too, as nothing
tells them apart. Digests are grouped with partial maxima; groups of two or more meet the pages
again in the tasks that read these, unless they are over HEADS.

Nulls: a null html is empty; a null page_id is never the largest (a group with none but null ids has responses only).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import new_path, shared_dir, stored

ARCHIVE_BYTES, DEDUP_BYTES, LEVEL, BLOCK = 64 << 20, 1000, 6, 1 << 18
#: Payloads with copies up to which their digests are sent to every task; more are joined by a shuffle.
HEADS = 1 << 20


def open_fs(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record; a revisit has no block."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + "".join((url or "").split()), f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page: {refers_to}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def header(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.lower()] = value.strip()
    return out


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC stream, given in blocks of any size."""
    held, need = bytearray(), 0
    for block in blocks:
        held += block
        while len(held) >= need:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                need = len(held) + 1
                break
            size = end + 4 + int(header(bytes(held[:end]))["content-length"]) + 4
            if len(held) < size:
                need = size
                break
            yield bytes(held[:size])
            del held[:size]
            need = 0
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def inflate(stream) -> Iterator[bytes]:
    """A file's gzip stream (or members in a row), inflated in bounded blocks."""
    z = zlib.decompressobj(31)
    while block := stream.read(BLOCK):
        while block:
            if z.eof:
                z = zlib.decompressobj(31)
            yield z.decompress(block, 4 * BLOCK)
            block = z.unconsumed_tail or z.unused_data
    yield z.flush()
    if not z.eof:
        raise ValueError("the gzip stream is cut off")


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html and _ref: the response's page_id for a revisit, else null."""
    df = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"_sha": F.sha1("html"), "_n": F.octet_length("html")})
    heads = df.filter(F.col("_n") >= DEDUP_BYTES).groupBy("_sha", "_n").agg(F.count(F.lit(1)).alias("_c"), F.max("page_id").alias("_ref")).filter("_c > 1").drop("_c")
    heads = stored(heads, "warc-heads")
    if heads.count() <= HEADS:
        heads = F.broadcast(heads)
    df = df.join(heads, ["_sha", "_n"], "left")
    return df.select("page_id", "url", "html", F.when(~F.col("_ref").eqNullSafe(F.col("page_id")), F.col("_ref")).alias("_ref"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """rows: page_id, url, html, _ref. Returns path, records of each file written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_fs(folder)
        path, out, z, size, n = "", None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

        for b in batches:
            for page, url, html, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "_ref")), strict=True):
                payload = html.encode()
                if out is not None and size + len(payload) > ARCHIVE_BYTES:
                    yield close()
                    out = None
                if out is None:
                    system.create_dir(top, recursive=True)
                    path, size, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = system.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(z.compress(record(page, url, payload, ref)))
                size, n = size + len(payload), n + 1
        if out is not None:
            yield close()

    return stored(rows.select("page_id", "url", "html", "_ref").mapInArrow(run, "path string, records long"), "warc-written")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """archives: path. Writes each file again with a member for each record, and its index beside it. Returns path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_fs(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                system.create_dir(top, recursive=True)
                new = f"{top}/{uuid.uuid4().hex}.warc.gz"
                at = 0
                with system.open_input_stream(path, compression=None) as stream, system.open_output_stream(new, compression=None) as out, system.open_output_stream(f"{new}.index", compression=None) as index:
                    for raw in split_records(inflate(stream)):
                        member = gzip.compress(raw, LEVEL, mtime=0)
                        out.write(member)
                        index.write(f"{at} {len(member)}\n".encode())
                        at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([new])], names=["path"])

    files = archives.select("path")
    return stored(files.repartition(max(1, min(archives.count(), 10_000)), "path").mapInArrow(run, "path string"), "warc-normalised")


def member(file, at: int, size: int) -> bytes:
    """A record of a normalised file, by its place in the sidecar index."""
    file.seek(at)
    return zlib.decompress(file.read(size), 31)


def read_records(archives: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest (checked on responses), record_type, refers_to by the indexes of normalised files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                system, _ = open_fs(folder)
                rows: list[tuple] = []
                with system.open_input_stream(f"{path}.index", compression=None) as lines, system.open_input_file(path) as file:
                    for line in lines.read().decode().splitlines():
                        raw = member(file, *map(int, line.split()))
                        end = raw.index(b"\r\n\r\n")
                        h = header(raw[:end])
                        payload = raw[end + 4 : -4]
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind = h["warc-type"]
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["payload-length"])):
                            raise ValueError(f"a payload in {path} differs from its digest")
                        rows.append((int(h["page-id"]) if "page-id" in h else None, h["warc-target-uri"], payload.decode() if kind == "response" else None, int(h["payload-length"]), digest, kind, int(h["refers-to-page"]) if "refers-to-page" in h else None))
                        if len(rows) == 500:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    folder = shared_dir(archives.sparkSession)
    return archives.select("path").mapInArrow(run, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_table(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, normalises and reads them."""
    spark = pages.sparkSession
    written = write_archives(with_references(pages), new_path(spark, "warc-monolithic"))
    return read_records(normalise(written, new_path(spark, "warc-members"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
