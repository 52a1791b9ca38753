"""WARC archives with a two-level capture index.

Records are written as gzip members of archive files; a payload that several pages share
is stored once, and the others become revisits. The index has two levels: capture lines,
sorted by reversed-host URL key, in compressed blocks; and a sparse directory with the
first key of each block. A lookup searches the directory by bisection, reads one range of
an index file, searches the block by bisection, and reads one range of an archive.

All files go through Spark's own readers and writers, so they may be in any file system
that Spark knows, and task retries are safe. Spark's text writer ends each row by one NUL,
which gzip readers skip as padding; each row is a whole file.

Layout below a folder: archives/ (gzip members), index/ (blocks, then a footer with the
shard's directory, then the footer's length), directory/ (Parquet, sorted by first key).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.shared import forget, small_batches, written
from webstrata.llm.textbytes import NULL_ID

SHARD_BYTES = 64 << 20
INDEX_SHARD_BYTES = 4 << 20
BLOCK_LINES = 1000
MIN_SHARED_BYTES = 0
BROADCAST_ROWS = 1_000_000
"""Most revisits, of 16 bytes each, that are sent to all executors; more are joined by a shuffle."""
DIRECTORY_ROWS = 200_000
"""Most directory rows that a lookup keeps in the driver; beyond, Spark searches the Parquet directory."""

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Reversed-host key: `com,example,www)/path?query`; port, user, scheme and fragment go; a leading `www.` stays."""
    if not url:
        return ")"
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for c in "/?" if (i := rest.find(c)) >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


def _target(url: str) -> str:
    """The url as a header value: white space, control and other characters that no URI has are escaped."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def _record(kind: str, page: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_target(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info() -> bytes:
    body = b"software: webstrata\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-info:0>\r\nWARC-Date: {_DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return headers, rest[: int(headers.get("content-length", 0))]


def _page_of(value: str | None) -> int | None:
    if not value or "urn:x-page:" not in value:
        return None
    return int(value.strip("<>").rpartition(":")[2])


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of the gzip members of an archive; NUL padding is skipped."""
    at, view = 0, memoryview(content)
    while at < len(content):
        if content[at] == 0:
            at += 1
            continue
        z = zlib.decompressobj(31)
        parts, fed = [], at
        while not z.eof and fed < len(content):
            parts.append(z.decompress(view[fed : fed + (1 << 16)]))
            fed += 1 << 16
        end = min(fed, len(content)) - len(z.unused_data)
        if not z.eof:
            raise ValueError("an archive ends within a record")
        yield at, end - at, b"".join(parts)
        at = end


def _write(rows: DataFrame, path: str) -> None:
    """Each row's bytes as a file of its own, ended by a NUL."""
    rows.select(F.col(rows.columns[0]).cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def revisits(pages: DataFrame, least: int = MIN_SHARED_BYTES) -> DataFrame:
    """(page, refers_to) of the pages whose payload, of at least `least` bytes, a larger page_id has too.

    Only ids and digests are shuffled; a payload that many pages share is reduced by partial maxima."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page"), F.sha1(payload.cast("binary")).alias("d"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    last = rows.groupBy("d", "n").agg(F.max("page").alias("refers_to"), F.min("page").alias("low")).where("low < refers_to").select("d", "n", "refers_to")
    return rows.join(last, ["d", "n"]).where("page < refers_to").select("page", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = MIN_SHARED_BYTES, shard_bytes: int = SHARD_BYTES) -> None:
    """Write a record for each page row: page_id, url, html.

    Null html is an empty payload; a null url gives a record without target; a null page_id
    counts as the smallest. Of equal payloads the row with the largest page_id is the
    response (repeated rows of it all are), the others are revisits of it."""
    small_batches(pages.sparkSession)
    found = written(revisits(pages, least))
    twice = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if not out:
                    out.append(_member(_info()))
                out.append(_member(_record("response" if refers_to is None else "revisit", page, url, (html or "").encode(), refers_to)))
                size += len(out[-1])
                if size >= shard_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["body"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["body"])

    _write(rows.join(twice, "page", "left").select("page", "url", "html", "refers_to").mapInArrow(run, "body binary"), f"{folder}/archives")
    forget(found)


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of the archives: key, page, path, offset, length. Records without a page are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, rows = batch.column(0)[k].as_py(), []
                for offset, length, record in members(batch.column(1)[k].as_py()):
                    headers, _ = parse(record)
                    if (page := _page_of(headers.get("warc-record-id"))) is not None:
                        rows.append((url_key(headers.get("warc-target-uri")), page, path, offset, length))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["key", "page", "path", "offset", "length"])

    return _read(spark, f"{folder}/archives").mapInArrow(run, "key string, page long, path string, offset long, length long")


def build_index(spark: SparkSession, folder: str, block_lines: int = BLOCK_LINES, shard_bytes: int = INDEX_SHARD_BYTES) -> None:
    """Write index/ and directory/ for archives/. Index files end after the block with which they reach shard_bytes.

    Captures without a url have the key `)`; repeated rows have a line each; captures of one key are
    ordered by page and may fill many blocks and files; empty archives give an empty directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, footer, lines, at = [], [], [], 0

        def close() -> None:
            nonlocal at
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            footer.append([lines[0][0], lines[-1][0], at, len(block), len(lines)])
            body.append(block)
            at += len(block)
            lines.clear()

        def shard() -> pa.RecordBatch:
            nonlocal at
            end = zlib.compress(json.dumps(footer).encode())
            out = pa.array([b"".join([*body, end, len(end).to_bytes(8, "big")])], pa.binary())
            body.clear(), footer.clear()
            at = 0
            return pa.RecordBatch.from_arrays([out], ["body"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(row)
                if len(lines) >= block_lines:
                    close()
                    if at >= shard_bytes:
                        yield shard()
        if lines:
            close()
        if body:
            yield shard()

    rows = captures(spark, folder)
    _write(rows.repartitionByRange("key", "page").sortWithinPartitions("key", "page", "path", "offset").mapInArrow(run, "body binary"), f"{folder}/index")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                footer = _footer(batch.column(1)[k].as_py())
                first, last, at, size, n = zip(*footer)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(last), pa.array([batch.column(0)[k].as_py()] * len(first)), pa.array(at), pa.array(size), pa.array(n)], ["first_key", "last_key", "path", "offset", "length", "lines"])

    parts = _read(spark, f"{folder}/index").mapInArrow(read, "first_key string, last_key string, path string, offset long, length long, lines long")
    parts.sort("first_key", "path", "offset").write.parquet(f"{folder}/directory")


def _footer(content: bytes) -> list:
    content = content[:-1]  # the writer's NUL
    size = int.from_bytes(content[-8:], "big")
    return json.loads(zlib.decompress(content[-8 - size : -8]))


def _lines(block: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(block).decode().split("\n")]


def read_range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """A range of a file of any file system that Spark knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


class Index:
    """Lookups of single urls in a folder written by write_archives and build_index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.table = spark, spark.read.parquet(f"{folder}/directory")
        self.rows = sorted(tuple(r) for r in self.table.limit(DIRECTORY_ROWS + 1).collect())
        if len(self.rows) > DIRECTORY_ROWS:
            self.rows = None

    def _blocks(self, key: str) -> list[tuple]:
        """The directory rows whose blocks can hold the key."""
        if self.rows is None:
            return [tuple(r) for r in self.table.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).sort("first_key", "path", "offset").collect()]
        at = bisect.bisect_right(self.rows, key, key=lambda r: r[0]) - 1
        out = []
        while at >= 0 and self.rows[at][1] >= key:  # a key may fill several blocks
            out.append(self.rows[at])
            at -= 1
        return out[::-1]

    def captures(self, url: str | None) -> list[list]:
        """The capture lines of a url: key, page, path, offset, length."""
        key, out = url_key(None if url is None else _target(url)), []
        for _, _, path, offset, length, _ in self._blocks(key):
            lines = _lines(read_range(self.spark, path, offset, length))
            low, high = bisect.bisect_left(lines, key, key=lambda x: x[0]), bisect.bisect_right(lines, key, key=lambda x: x[0])
            out += lines[low:high]
        return out

    def records(self, url: str | None) -> list[tuple[dict[str, str], bytes]]:
        """Headers and block of each capture of a url, each by one range read."""
        return [parse(next(members(read_range(self.spark, path, offset, length)))[2]) for _, _, path, offset, length in self.captures(url)]


def index_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All capture lines, read from the index's blocks: key, page, path, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = batch.column(1)[k].as_py()
                for _, _, at, size, _ in _footer(content):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*_lines(content[at : at + size]))], ["key", "page", "path", "offset", "length"])

    return _read(spark, f"{folder}/index").mapInArrow(run, "key string, page long, path string, offset long, length long")


def requests(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(key): the distinct index keys of urls; null urls have one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(None if u is None else _target(u)) for u in batch.column(0).to_pylist()], pa.string())], ["key"])

    return urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The capture lines of many distinct keys: key, page, path, offset, length.

    The index files that can hold a key are found by bisection in the first level, the files' first and
    last keys; a key with very many captures has several. Each file with wanted keys is read once; in it, blocks
    are found by bisection in its directory, and lines by bisection in the blocks, of which only
    those with wanted keys are decompressed. If more than DIRECTORY_ROWS files make the first level
    too large to send, the keys are joined with all lines."""
    files = spark.read.parquet(f"{folder}/directory").groupBy("path").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
    found = sorted((r.low, r.high, r.path) for r in files.limit(DIRECTORY_ROWS + 1).collect())
    if len(found) > DIRECTORY_ROWS:
        return index_lines(spark, folder).join(keys, "key", "left_semi")
    first = spark.sparkContext.broadcast(found)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = first.value
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                at = bisect.bisect_right(rows, key, key=lambda r: r[0]) - 1
                while at >= 0 and rows[at][1] >= key:
                    out.append((rows[at][2], key))
                    at -= 1
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["path", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content, wanted = batch.column(0)[k].as_py(), sorted(batch.column(1)[k].as_py())
                for low, high, at, size, _ in _footer(content):
                    own = wanted[bisect.bisect_left(wanted, low) : bisect.bisect_right(wanted, high)]
                    if not own:
                        continue
                    lines, out = _lines(content[at : at + size]), []
                    for key in own:
                        out += lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["key", "page", "path", "offset", "length"])

    own = keys.mapInArrow(choose, "path string, key string").groupBy("path").agg(F.collect_list("key").alias("keys"))  # no more than a file has lines, and those between two of them
    return _read(spark, f"{folder}/index").join(own, "path").select("content", "keys").mapInArrow(search, "key string, page long, path string, offset long, length long")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """What each record of the archives holds: path, offset, length, page, payload_bytes,
    payload_digest, record_type, refers_to. Payloads don't leave the task that reads them.

    Of responses size and digest are computed from the payload, of revisits they are the
    record's own. A record that disagrees with its digest header is an error."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["path", "offset", "length", "page", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, out = batch.column(0)[k].as_py(), []
                for offset, length, record in members(batch.column(1)[k].as_py()):
                    headers, block = parse(record)
                    if (page := _page_of(headers.get("warc-record-id"))) is None:
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                    kind = headers["warc-type"]
                    if kind == "response" and (payload_digest(payload), len(payload)) != (stated, size):
                        raise ValueError(f"record {headers['warc-record-id']} doesn't have the payload that its headers state")
                    out.append((path, offset, length, page, size, stated, kind, _page_of(headers.get("warc-refers-to"))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return _read(spark, f"{folder}/archives").mapInArrow(run, "path string, offset long, length long, page long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_back(spark: SparkSession, folder: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per capture of the urls, found through the index, with the record that stands at its range
    of the archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key.

    Repeated urls are looked up once; urls without a capture give no row; null urls find the records
    without target. See `lookup` and `records`."""
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias("page_id" if c == "page" else c)
    found = lookup(spark, folder, requests(urls, url_col)).join(records(spark, folder), ["path", "offset", "length", "page"])
    return found.select(shown("page"), "payload_bytes", "payload_digest", "record_type", shown("refers_to"), F.col("key").alias("url_key"))
