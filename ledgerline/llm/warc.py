"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of whole WARC/1.1 records (about FRAME bytes, or one
longer record), and a last, skippable frame: the seek table with every frame's compressed and plain size, as the public
seekable format lays it out. An index has each record's bundle, frame and place within the plain frame, so one record is read
by the table's few bytes and one frame.

Pages are stored once in row order under numbers that name the records. Of pages with equal payloads (by SHA-256, of at least
``least`` bytes) the one with the smallest id is a ``response``, the others are ``revisit`` records, which keep the HTTP head
with the payload's length and digest, and name the record that they refer to. A payload's copies are found by a combining
aggregate; the marks of revisits are joined to the pages bucket by bucket where these lie, so no payload is shuffled or
sorted and a payload that a third of all pages have is no hot key. Bundles are written into the shared folder under names
of their own by each attempt of a task; the index is what commits them: of a lost or repeated attempt no row is left.

Null html is an empty payload, a null id is the response only if all ids are null, and reads back as null; of
repeated ids one row is the response. A null url gives no target line. Lines and control characters in urls are written in
percent form. An empty table gives no bundle and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Numbered, saved, shared_dir

#: Plain bytes of a frame, compressed bytes of a bundle; a record is never split.
FRAME, BUNDLE = 1 << 20, 256 << 20
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def storage(where: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file in the shared folder."""
    scheme = urlparse(where).scheme
    return (fs.LocalFileSystem(), urlparse(where).path) if scheme in ("", "file") else fs.FileSystem.from_uri(where)


class Bundle:
    """A bundle being written; ``add`` gives the frame and the place of a record in it."""

    def __init__(self, where: str) -> None:
        self.where = f"{where}/{uuid.uuid4().hex}.warc.zst"
        system, path = storage(self.where)
        self.out = system.open_output_stream(path, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.plain = self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.held and self.plain + len(record) > FRAME:
            self.flush()
        at = len(self.frames), self.plain
        self.held.append(record)
        self.plain += len(record)
        return at

    def flush(self) -> None:
        if self.held:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(self.held))
            self.out.write(data)
            self.frames.append((len(data), self.plain))
            self.size += len(data)
            self.held, self.plain = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(data: fs.NativeFile) -> list[tuple[int, int, int]]:
    """Start, compressed and plain size of each frame, from the end of an open bundle."""
    end = data.size()
    data.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", data.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8  # with or without checksums
    data.seek(end - 9 - n * width)
    rows, start, out = data.read(n * width), 0, []
    for k in range(n):
        size, plain = struct.unpack_from("<II", rows, k * width)
        out.append((start, size, plain))
        start += size
    return out


def frame(data: fs.NativeFile, start: int, size: int, plain: int) -> bytes:
    data.seek(start)
    return zstandard.ZstdDecompressor().decompress(data.read(size), max_output_size=plain)


def record_name(row: int, page: object) -> str:
    return f"<urn:page:{row}:{'' if page is None else page}>"


def page_of(name: str) -> str | None:
    return name[1:-1].split(":", 3)[3] or None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _record(name: str, url: str | None, payload: bytes, original: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original else http + payload
    head = [f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if original:
        head += [f"WARC-Refers-To: {original}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"".join([b"WARC/1.1\r\n", "\r\n".join(head).encode(), b"\r\n\r\n", block, b"\r\n\r\n"])


def records(plain: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, named fields and block of each record of a frame."""
    at = 0
    while at < len(plain):
        stop = plain.index(b"\r\n\r\n", at)
        lines = plain[at:stop].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        yield at, fields, plain[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def _parsed(fields: dict[str, str], block: bytes) -> tuple:
    """id, url, type, the page referred to, payload length and digest, html (of a revisit none)."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (size != len(payload) or digest(payload) != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    original = fields.get("WARC-Refers-To")
    return page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, page_of(original) if original else None, size, stated, payload.decode() if kind == "response" else None


def archive(pages: DataFrame, *, least: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the bundles; the result is the index: ``page_id, record_id, bundle, frame, at, size`` of each record."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    system, path = storage(folder)
    system.create_dir(path, recursive=True)
    rows = pages.select(pages[id_col].alias("page"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, index = None, []

        def told() -> pa.RecordBatch:
            bundle.close()
            cols = [pa.array(c) for c in zip(*index, strict=True)]
            return pa.RecordBatch.from_arrays([cols[0].cast(pages_kind), *cols[1:]], names=["page", "record_id", "bundle", "frame", "at", "size"])

        for batch in batches:
            pages_kind = batch.schema.field("page").type
            for k in range(batch.num_rows):
                row, page, url, html, first_row, first = (batch.column(c)[k].as_py() for c in ("row", "page", "url", "html", "first_row", "first"))
                bundle = bundle or Bundle(folder)
                name = record_name(row, page)
                record = _record(name, url, html.encode(), None if first_row is None else record_name(first_row, first), date)
                index.append((page, name, bundle.where, *bundle.add(record), len(record)))
                if bundle.size > BUNDLE:
                    yield told()
                    bundle, index = None, []
        if bundle:
            yield told()

    stored = Numbered(rows, "pages")
    known = stored.table.filter(F.octet_length("html") >= least).select("row", "page", F.sha2("html", 256).alias("sum"))
    known = saved(known, "payloads")
    smallest = F.min_by(F.struct("page", "row"), F.struct(F.col("page").isNull(), "page", "row"))
    groups = known.groupBy("sum").agg(smallest.alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = known.join(groups, "sum").filter("first.row <> row").select("row", F.col("first.row").alias("first_row"), F.col("first.page").alias("first"))
    marked = stored.marked(later).select("row", "page", "url", "html", "mark.*")
    index = saved(marked.mapInArrow(write, f"page {kind}, record_id string, bundle string, frame long, at long, size long"), "warc-index")
    return index.withColumnRenamed("page", id_col)


def read_archive(index: DataFrame, kind: str = "long", id_col: str = "page_id") -> DataFrame:
    """All records of the bundles that ``index`` names, read frame by frame, a task for each: ``page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, html``; ids are cast to ``kind``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.column("bundle").to_pylist():
                system, path = storage(where)
                with system.open_input_file(path) as data:
                    for place in seek_table(data):
                        yield _batch([_parsed(fields, block) for _, fields, block in records(frame(data, *place))])

    bundles = index.select("bundle").distinct()
    return _typed(bundles.repartition(max(1, bundles.count())).mapInArrow(read, _READ), kind, id_col)


def lookup(index: DataFrame, record_ids: DataFrame, kind: str = "long", id_col: str = "page_id") -> DataFrame:
    """The records of ``record_ids.record_id``, each read from its own frame alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = storage(row["bundle"])
                with system.open_input_file(path) as data:
                    plain = frame(data, *seek_table(data)[row["frame"]])
                    yield _batch([_parsed(*next(records(plain[row["at"] : row["at"] + row["size"]]))[1:])])

    wanted = index.join(record_ids.select("record_id").distinct(), "record_id").select("bundle", "frame", "at", "size")
    return _typed(wanted.mapInArrow(read, _READ), kind, id_col)


_READ = "page string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, html string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split(" ")[0] for c in _READ.split(", ")])


def _typed(found: DataFrame, kind: str, id_col: str) -> DataFrame:
    return found.select(F.col("page").cast(kind).alias(id_col), "url", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "payload_bytes", "payload_digest", "html")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archive(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BITS = "CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT)"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {shift}) & 31 AS BIGINT) + 1, 1)"
OP13_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS first FROM pages)
SELECT page_id, octet_length(encode(t)) AS payload_bytes,
  array_to_string(list_transform(list_transform(range(8), lambda k: {_BITS}), lambda v: {" || ".join(_LETTER.format(shift=s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p
"""
