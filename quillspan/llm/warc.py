"""Operator 7, WARC archives through a chunked record table.

A payload is never one value on its way: it is a stream of rows (record id,
chunk number, bytes) of at most ``CHUNK`` bytes, each with the SHA-1 of the
payload up to there, so that the last row of a record has its digest.

Writing: pages become chunk rows (a work table); digests of last rows decide
which record is the response and which revisit it; chunk rows are dealt by
record id, sorted, and streamed into gzip-member-per-record archives in the
shared folder.  A task writes under a name of its own attempt and reports it,
so a repeated task leaves no record twice.  Reading: archives are inflated and
parsed as streams into the same chunk rows; every digest is checked.

The archives lie in the folder of ``spark.checkpoint.dir`` and are written
through pyarrow's file systems.

Defined cases: null html is an empty payload; empty payloads are equal to each
other; of equal payloads the largest page id is the response (a null id is
the smallest); repeated rows: one is the response, the others revisit it; a
null url leaves the header out; an empty table gives no archive and an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import binary_text
from quillspan.sources.scratch import keep, new_folder

CHUNK = 1 << 16
#: Rows are handed on when so many payload bytes wait.
FLUSH = 4 << 20

CHUNKS = "rid long, page_id long, url string, chunk_no int, chunk binary, bytes long, sha1 binary, xxh128 binary, last boolean"
_CHUNKS = pa.schema(
    [("rid", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("bytes", pa.int64()), ("sha1", pa.binary()), ("xxh128", pa.binary()), ("last", pa.bool_())]
)
RECORDS = "record_id string, page_id long, record_type string, refers_to long, url string, chunk_no int, chunk binary, bytes long, sha1 binary, last boolean, payload_bytes long, payload_digest string"
_RECORDS = pa.schema(
    [
        ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()),
        ("chunk", pa.binary()), ("bytes", pa.int64()), ("sha1", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ]
)


def _flushed(rows: Iterator[tuple], schema: pa.Schema, payload: int) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded payload."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[payload] or b"")
        if size >= FLUSH or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def chunk_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The chunked record table of ``pages``, as a work table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(batch.num_rows):
                number, address, payload = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), memoryview(batch.column(2)[i].as_buffer())
                digest, second = hashlib.sha1(), xxhash.xxh3_128()
                for k in range(max(1, -(-len(payload) // CHUNK))):
                    part = payload[k * CHUNK : (k + 1) * CHUNK]
                    digest.update(part)
                    second.update(part)
                    stop = k * CHUNK + len(part)
                    yield rid, number, address, k, bytes(part), stop, digest.digest(), second.digest(), stop == len(payload)
                rid += 1

    narrow = pages.select(pages[f"`{page_id}`"].cast("long").alias("page_id"), pages[f"`{url}`"].cast("string").alias("url"), binary_text(pages[f"`{html}`"]).alias("html"))
    return keep(narrow.mapInArrow(lambda batches: _flushed(rows(batches), _CHUNKS, 4), CHUNKS), "chunks")


def decisions(chunks: DataFrame) -> DataFrame:
    """rid, page_id, url, bytes, sha1 and the response's rid and page id of every record."""
    last = chunks.filter("last").select("rid", "page_id", "url", "bytes", "sha1", "xxh128")
    winners = last.groupBy("sha1", "xxh128", "bytes").agg(F.max(F.struct("page_id", "rid")).alias("response"))
    return last.join(winners, ["sha1", "xxh128", "bytes"]).select(
        "rid", "page_id", "url", "bytes", "sha1", F.col("response.rid").alias("response_rid"), F.col("response.page_id").alias("response_page")
    )


def _record_id(page_id: int | None, rid: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{rid}>"


def _head(row: dict, date: str) -> tuple[bytes, bool]:
    """WARC and HTTP headers of a record, and whether its payload follows."""
    response = row["rid"] == row["response_rid"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_record_id(row['page_id'], row['rid'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~-._"))
    if not response:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_record_id(row['response_page'], row['response_rid'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(row['sha1']).decode()}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(http) + (row['bytes'] if response else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http, response


def write_archives(chunks: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Stream the chunk table into archives under ``folder``; a kept table of (path, records)."""
    fields = ["rid", "chunk_no", "page_id", "url", "bytes", "sha1", "response_rid", "response_page", "chunk"]
    heads = decisions(chunks).withColumn("chunk_no", F.lit(-1)).withColumn("chunk", F.lit(None).cast("binary"))
    none = F.lit(None)
    body = chunks.select(
        "rid", "chunk_no", none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("long").alias("bytes"), none.cast("binary").alias("sha1"),
        none.cast("long").alias("response_rid"), none.cast("long").alias("response_page"), "chunk",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        path = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out = deflate = None
        records, wanted = 0, False
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] < 0:
                    if out is None:
                        system, place = fs.FileSystem.from_uri(path)
                        system.create_dir(place.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(place, compression=None)
                    if deflate is not None:
                        out.write(deflate.compress(b"\r\n\r\n") + deflate.flush())
                    head, wanted = _head(row, date)
                    deflate = zlib.compressobj(6, wbits=31)
                    out.write(deflate.compress(head))
                    records += 1
                elif wanted:
                    out.write(deflate.compress(row["chunk"]))
        if out is not None:
            out.write(deflate.compress(b"\r\n\r\n") + deflate.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=["path", "records"])

    spark = chunks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    streams = heads.select(fields).unionByName(body).repartition(n, "rid").sortWithinPartitions("rid", "chunk_no")
    return keep(streams.mapInArrow(write, "path string, records long"), "archives")


class _Member:
    """The bytes of one gzip member, drawn on demand from a compressed stream."""

    def __init__(self, source, carry: bytes):
        self.source, self.waiting, self.inflate, self.ready = source, carry, zlib.decompressobj(wbits=31), b""

    def more(self) -> bool:
        while not self.inflate.eof:
            data = self.waiting or self.source.read(CHUNK)
            if not data:
                raise ValueError("the archive ends inside a record")
            got = self.inflate.decompress(data, CHUNK)
            self.waiting = self.inflate.unconsumed_tail
            if got:
                self.ready += got
                return True
        return False

    def until_blank_line(self) -> list[str]:
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a record without the end of its headers")
        head, self.ready = self.ready[:at], self.ready[at + 4 :]
        return head.decode().split("\r\n")

    def take(self, size: int) -> bytes:
        while len(self.ready) < size and self.more():
            pass
        got, self.ready = self.ready[:size], self.ready[size:]
        return got

    def rest(self) -> bytes:
        """Reads on to the member's end; what follows in the stream."""
        while self.more():
            self.ready = b""
        return self.inflate.unused_data


def _parsed(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(urn: str) -> int | None:
    number = urn.strip("<>").split(":")[2]
    return int(number) if number else None


def _records(source, payload: bool) -> Iterator[tuple]:
    carry = source.read(CHUNK)
    while carry:
        member = _Member(source, carry)
        head = _parsed(member.until_blank_line())
        http = _parsed(member.until_blank_line())
        total, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
        kind, refers = head["warc-type"], head.get("warc-refers-to")
        fixed = head["warc-record-id"], _page(head["warc-record-id"]), kind, _page(refers) if refers else None, head.get("warc-target-uri")
        if kind == "revisit":
            yield *fixed, 0, None, 0, None, True, total, digest
        else:
            sha1, done, k = hashlib.sha1(), 0, 0
            while True:
                part = member.take(min(CHUNK, total - done))
                sha1.update(part)
                done += len(part)
                last = done == total
                if not part and not last:
                    raise ValueError(f"{fixed[0]}: the payload is shorter than its header says")
                if last and base64.b32encode(sha1.digest()).decode() != digest:
                    raise ValueError(f"{fixed[0]}: the payload does not have the digest in its header")
                yield *fixed, k, part if payload else None, done, sha1.digest(), last, total, digest
                k += 1
                if last:
                    break
        carry = member.rest() or source.read(CHUNK)


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Chunk rows of all records in the archives at ``path``; ``payload=False`` leaves the bytes out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_stream(place, compression=None) as source:
                    yield from _flushed(_records(source, payload), _RECORDS, 6)

    spark = archives.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n, "path").mapInArrow(read, RECORDS)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder; a table of their paths."""
    return write_archives(chunk_rows(pages, page_id, url, html), new_folder(pages.sparkSession, "warc"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    records = read_archives(archives, payload=False).filter("last")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}
ORACLE = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS resp FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(i * 5 + 1 AS INT), 5) AS INT)) AS g FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(g, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = resp THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> resp THEN resp END AS refers_to FROM b"""
}
