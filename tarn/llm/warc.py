"""WARC archives: writing, normalising monolithic gzip files, reading by offset index.

write_archives() packs pages into WARC 1.1 files, each one whole-file gzip
stream. normalise() inflates such a stream once, front to back, rewrites every
record as a gzip member of its own and writes a sidecar index of the members'
offsets. read_archives() seeks to each member by the index. All three work file
by file in bounded pieces; the file system is the session's shared folder.

Of records with equal payloads the one with the largest page_id carries the
payload, the others are `revisit` records that refer to it. Digests alone are
aggregated; the pages join their digest's result, a join that Spark may split
where one payload is very frequent.

Files get names of their own for each attempt and are moved into place when
complete; only files named in the written manifest are read, so a lost executor
leaves at most unread files behind.

Defined results: null html is an empty payload; null page ids are kept and count
as smaller than any other; rows that repeat the largest page_id of a payload are
all responses; a null url gives no target URI; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import Workspace

#: Inflated bytes after which a writing task starts its next file.
ARCHIVE_BYTES = 32 << 20
PIECE = 1 << 20
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


class Files:
    """Binary files below a folder that all executors reach: a shared mount, or a store that pyarrow knows."""

    def __init__(self, folder: str):
        parsed = urlparse(folder)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.root = parsed.path
            os.makedirs(self.root, exist_ok=True)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)
            self.fs.create_dir(self.root, recursive=True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str):
        return open(self.path(name), "wb") if self.local else self.fs.open_output_stream(self.path(name))

    def open(self, name: str):
        return open(self.path(name), "rb") if self.local else self.fs.open_input_file(self.path(name))

    def move(self, old: str, new: str) -> None:
        if self.local:
            os.replace(self.path(old), self.path(new))
        else:
            self.fs.move(self.path(old), self.path(new))

    def delete(self, name: str) -> None:
        if self.local:
            os.unlink(self.path(name))
        else:
            self.fs.delete_file(self.path(name))


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record with its closing blank lines."""
    head = EMPTY_HEAD + str(len(payload)).encode() + b"\r\n\r\n"
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {page_urn(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        lines += [f"WARC-Refers-To: {page_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and the block of a whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in pieces."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(PIECE):
        while data:
            if out := inflate.decompress(data, PIECE):
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
    if out := inflate.flush():
        yield out


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of pieces; holds one record and one piece."""
    buffer = bytearray()
    need = -1
    for piece in pieces:
        buffer += piece
        while True:
            if need < 0:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(int(x.partition(b":")[2]) for x in bytes(buffer[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = -1
    if buffer:
        raise ValueError("the archive ends inside a record")


def normalise_file(files: Files, name: str, target: str) -> tuple[int, int]:
    """Rewrites one archive as a member for each record, with target.idx beside it. Returns records and bytes."""
    own = uuid.uuid4().hex
    count = at = 0
    with files.open(name) as source, files.create(f"{own}.gz") as out, files.create(f"{own}.idx") as index:
        for data in split_records(inflated(source)):
            pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = pack.compress(data) + pack.flush()
            out.write(member)
            fields = data[: data.index(b"\r\n\r\n")].decode().split("\r\n")
            ident = next(x.partition(":")[2].strip() for x in fields if x.lower().startswith("warc-record-id:"))
            index.write(json.dumps([ident, at, len(member), len(data)]).encode() + b"\n")
            at += len(member)
            count += 1
    files.move(f"{own}.gz", target)
    files.move(f"{own}.idx", f"{target}.idx")
    return count, at


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to and revisit of each page."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    # Equal payloads are told by SHA-256: for SHA-1, which the records carry, different ones with one digest are in circulation.
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    kept = rows.select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("kept_id"))
    marked = rows.join(kept, "digest")
    revisit = ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    return marked.select("page_id", "url", "payload", F.when(revisit, F.col("kept_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(marked: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Monolithic gzip archives of mark_revisits() rows below folder; a row (name, records, bytes) for each."""

    def run(batches):
        import pyarrow as pa

        files, made = Files(folder), []
        out = pack = None
        name, size, count = "", 0, 0

        def close():
            out.write(pack.flush())
            out.close()
            files.move(name, f"{name}.warc.gz")
            made.append((f"{name}.warc.gz", count, size))

        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(i)[at].as_py() for i, c in enumerate(batch.schema.names)}
                if out is None:
                    name, size, count = uuid.uuid4().hex, 0, 0
                    out, pack = files.create(name), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"], date)
                out.write(pack.compress(data))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "records", "bytes"), x, strict=True)) for x in made], schema=pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return marked.mapInArrow(run, "name string, records long, bytes long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive named in archives within folder; a row (name, records, bytes) of each new file."""

    def run(batches):
        import pyarrow as pa

        files = Files(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                count, size = normalise_file(files, name, f"n-{name}")
                yield pa.RecordBatch.from_pydict({"name": [f"n-{name}"], "records": [count], "bytes": [size]}, schema=pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return archives.select("name").mapInArrow(run, "name string, records long, bytes long")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the normalised files in folder, found by their offset indexes.

    payload (only with payloads=True) is null for revisits, which store none.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches):
        import pyarrow as pa

        files, names = Files(folder), [x.split()[0] for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        target = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open(name) as data, files.open(f"{name}.idx") as index:
                    for line in index.read().splitlines():
                        ident, at, size, _ = json.loads(line)
                        data.seek(at)
                        fields, block = parse_record(zlib.decompress(data.read(size), 31))
                        if fields["warc-record-id"] != ident:
                            raise ValueError(f"{name}: the index does not fit the archive")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        revisit = fields["warc-type"] == "revisit"
                        length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{name}: {ident} does not hold its payload")
                        row = (page_of(ident), fields.get("warc-target-uri"), length, digest, fields["warc-type"], page_of(fields["warc-refers-to"]) if revisit else None)
                        rows.append(row + ((None if revisit else payload),) * payloads)
                        held += len(payload) * payloads + 100
                        if held > PIECE * 8:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=target)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=target)

    return manifest.select("name").mapInArrow(run, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, work: Workspace | None = None) -> tuple[DataFrame, str]:
    """Writes pages as monolithic archives and normalises them. Returns the manifest and its folder."""
    work = work or Workspace(spark, "warc")
    folder = f"{work.path}/archives"
    written = work.table(write_archives(mark_revisits(pages), folder), "written")
    tasks = max(1, spark.sparkContext.defaultParallelism)
    listed = written.repartition(max(tasks, min(written.count(), 10_000)), "name")
    return work.table(normalise(listed, folder), "manifest"), folder
