"""WARC archives on shared storage: monolithic gzip in, one gzip member per record with an offset index out.

``write`` stores pages as WARC records, each archive one gzip stream over the whole file, as some crawlers leave them.
``normalise`` inflates every such stream once, in blocks, and rewrites each record as a member of its own; a sidecar
index lists record id, type, target, offset and length of each member, so that ``read`` can seek to any record.

Pages with equal payloads are stored once: the one with the largest page id is the response, the others are revisit
records that refer to it and carry digest and size of the payload they leave out.

Tasks write whole files under names that depend on the run's folder and their content only and rename them into place,
so a task that is repeated on another executor leaves the same files.

Results: null html is an empty payload, null ids and urls come back as null. Rows repeated under the largest page id of
a payload are all responses; without any id in a group all rows are. An empty table gives no archive and no rows. Other
columns of the input are not stored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Payload bytes per archive, and bytes inflated or deflated at once.
ARCHIVE_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
PAGE_DATE = "2024-01-01T00:00:00Z"
_HEADER_END = b"\r\n\r\n"

ARCHIVE_SCHEMA = "archive string, records bigint"
INDEX_SCHEMA = "archive string, offset bigint, length bigint, record_id string, record_type string, target string"
RECORD_SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "payload binary"
)


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 160-bit hex digest: 40 bits at a time."""
    digits = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to). Only payloads that occur twice have a row to join with,
    so the join moves rows once, and a payload that very many pages share is split by the optimizer."""
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", base32_of_hex(F.sha1("payload")))
    shared = (
        rows.groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("shared_digest"), "first")
    )
    refers = F.when(F.coalesce(F.col("page_id") < F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull()), F.col("first"))
    return (
        rows.join(shared, F.col("digest") == F.col("shared_digest"), "left")
        .withColumn("refers_to", refers)
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
        .select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    name = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def _quoted(url: str) -> str:
    """Header values hold no control characters; those, other alphabets and % are percent-encoded."""
    return re.sub(rb"[^\x21-\x24\x26-\x7e]", lambda m: b"%%%02X" % m.group()[0], url.encode()).decode()


def _unquoted(value: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m.group(1), 16)]), value.encode()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {PAGE_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_quoted(url)}")
    if kind == "revisit":
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + _HEADER_END + block + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines) if name}


def parsed(record: bytes) -> dict:
    """Row of one record."""
    head, _, rest = record.partition(_HEADER_END)
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(_HEADER_END)
    kind = fields["warc-type"]
    url = fields.get("warc-target-uri")
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "url": None if url is None else _unquoted(url),
        "record_type": kind,
        "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload_bytes": int(headers(http)["content-length"]),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "payload": payload if kind == "response" else None,
    }


def records_of(source: BinaryIO) -> Iterator[bytes]:
    """Records of a gzip file, whatever its members: inflated once, a block at a time, holding one record."""
    inflate, held = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal inflate
        while True:
            if inflate.eof:
                rest = inflate.unused_data or source.read(BLOCK_BYTES)
                if not rest:
                    return False
                inflate = zlib.decompressobj(31)
            else:
                rest = inflate.unconsumed_tail or source.read(BLOCK_BYTES)
                if not rest:
                    raise EOFError("archive ends inside a gzip member")
            out = inflate.decompress(rest, BLOCK_BYTES)
            if out:
                held.extend(out)
                return True

    while True:
        searched = 0
        while (end := held.find(_HEADER_END, max(0, searched - 3))) < 0:
            searched = len(held)
            if not more():
                if held.strip():
                    raise EOFError("archive ends inside a record")
                return
        size = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise EOFError("archive ends inside a record")
        yield bytes(held[:size])
        del held[:size]


class Placed:
    """File that appears under its name only when it is whole."""

    def __init__(self, path: str) -> None:
        self.files, self.path = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)

    def __enter__(self):
        from pyspark import TaskContext

        task = TaskContext.get()
        self.draft = f"{self.path}.{task.taskAttemptId() if task else 0}.part"
        self.out = self.files.open_output_stream(self.draft)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.files.move(self.draft, self.path)


def _opened(path: str):
    files, inside = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return files.open_input_file(inside)


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stores pages as monolithic archives in a folder; returns (archive, records) once all are written."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            size, count, name, parts = 0, 0, hashlib.sha256(), []
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            while row is not None and (not count or size < archive_bytes):
                data = record_bytes(
                    row["page_id"], row["url"], row["payload"], row["digest"], row["record_type"], row["refers_to"]
                )
                name.update(data)
                parts.append(deflate.compress(data))
                size, count, row = size + len(data), count + 1, next(rows, None)
            path = f"{folder}/{name.hexdigest()[:32]}.warc.gz"
            with Placed(path) as out:
                for part in [*parts, deflate.flush()]:
                    out.write(part)
            yield pa.RecordBatch.from_pylist([{"archive": path, "records": count}])

    return with_records(pages).mapInArrow(store, ARCHIVE_SCHEMA)


def dealt(archives: DataFrame) -> DataFrame:
    """A written list of archives, about one per task: its rows are small and the files behind them are not, so the number
    of tasks follows from the number of archives, which no size of the list may reduce."""
    return archives.repartition(max(1, archives.count()), "archive")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives with one member per record and writes their sidecar indexes; returns (archive, records)."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{source.rpartition('/')[2]}"
                index, at = [], 0
                with _opened(source) as monolith, Placed(target) as out:
                    for record in records_of(monolith):
                        fields = headers(record.partition(_HEADER_END)[0])
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = deflate.compress(record) + deflate.flush()
                        out.write(member)
                        index.append(
                            {
                                "archive": target, "offset": at, "length": len(member), "record_id": fields["warc-record-id"],
                                "record_type": fields["warc-type"], "target": fields.get("warc-target-uri"),
                            }
                        )
                        at += len(member)
                with Placed(f"{target}.idx.json") as out:
                    out.write("".join(json.dumps(line) + "\n" for line in index).encode())
                yield pa.RecordBatch.from_pylist([{"archive": target, "records": len(index)}])

    return archives.select("archive").mapInArrow(rewrite, ARCHIVE_SCHEMA)


def index_of(archives: DataFrame) -> DataFrame:
    """Index rows of normalised archives, read from their sidecars."""
    kind = pa.schema(
        [(n, pa.int64() if n in ("offset", "length") else pa.string()) for n in re.findall(r"(\w+) \w+", INDEX_SCHEMA)]
    )

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with _opened(f"{archive}.idx.json") as sidecar:
                    lines = [json.loads(line) for line in sidecar.read().splitlines()]
                yield pa.RecordBatch.from_pylist(lines, kind)

    return archives.select("archive").mapInArrow(load, INDEX_SCHEMA)


def read(index: DataFrame) -> DataFrame:
    """Records at the places an index lists, each by one seek and one inflation of its member."""
    names = re.findall(r"(\w+) \w+", RECORD_SCHEMA)
    kinds = {"url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows, size = [], 0
            for place in batch.to_pylist():
                if place["archive"] != name:
                    if source:
                        source.close()
                    name, source = place["archive"], _opened(place["archive"])
                source.seek(place["offset"])
                rows.append(parsed(zlib.decompress(source.read(place["length"]), 31)))
                size += rows[-1]["payload_bytes"]
                if size > 8 * BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        if source:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(fetch, RECORD_SCHEMA)
