"""Archive records (WARC and ARC, plain or gzip) as rows.

`read_records` reads files with Spark's binaryFile source and parses them with
mapInArrow, a file a task; `ArchiveDataSource` offers the same rows as
`spark.read.format("archive")`. A record's position and length are those of its bytes in
the file, of its gzip member where the file is compressed. `path` identifies the file
(base names repeat), and `number` counts its records. The request that belongs to a
capture stands right after it, so it is found while parsing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = """filename string, position long, length long, type string, record_id string, url string, date string, concurrent_to array<string>, software string,
    content_type string, digest string, headers map<string,string>, http_header string, payload binary, truncated boolean, path string, number long, request_method string, request_body string"""

_NAMES = ["filename", "position", "length", "type", "record_id", "url", "date", "concurrent_to", "software", "content_type", "digest", "headers", "http_header", "payload", "truncated", "path", "number", "request_method", "request_body"]
_ARROW = pa.schema(
    [
        ("filename", pa.string()), ("position", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()),
        ("concurrent_to", pa.list_(pa.string())), ("software", pa.string()), ("content_type", pa.string()), ("digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
        ("http_header", pa.string()), ("payload", pa.binary()), ("truncated", pa.bool_()), ("path", pa.string()), ("number", pa.int64()), ("request_method", pa.string()), ("request_body", pa.string()),
    ]
)

_ARC_LINE = re.compile(rb"(\S+) (\S+) (\d{12,18}) (\S+)(?: .*?)? (\d+)\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_PADDING = re.compile(rb"[\r\n\0]*")
_REQUEST = re.compile(rb"([A-Z]+) ")
ARCHIVE_GLOB = "*.{warc,warc.gz,warc.gz.open,warc.open,arc,arc.gz}"


def _members(content: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """(position, length, bytes, cut off?) of each gzip member, or of the whole of a plain file."""
    if content[:2] != b"\x1f\x8b":
        yield 0, len(content), content, False
        return
    at = 0
    while at < len(content):
        if content[at : at + 2] != b"\x1f\x8b":
            return
        z, out, fed = zlib.decompressobj(31), [], at
        try:
            while not z.eof and fed < len(content):
                out.append(z.decompress(content[fed : fed + 65536]))
                fed += 65536
        except zlib.error:
            yield at, len(content) - at, b"".join(out), True
            return
        end = min(fed, len(content)) - len(z.unused_data)
        yield at, end - at, b"".join(out), not z.eof
        at = end


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in re.split(rb"\r?\n", head):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon and not line[:1].isspace():
            out.append((name.strip().lower(), value.strip()))
        elif out and line[:1].isspace():  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.decode('utf-8', 'replace').strip()}")
    return out


def _split_http(block: bytes) -> tuple[str | None, bytes]:
    if not block.startswith(b"HTTP/"):
        return None, block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block.decode("latin-1"), b"") if not m else (block[: m.start()].decode("latin-1"), block[m.end() :])


def _warc(text: bytes, at: int) -> tuple[dict, int] | None:
    m = _HEAD_END.search(text, at) if text.startswith(b"WARC/", at) else None
    if not m:
        return None
    fields = _fields(text[at : m.start()])
    headers: dict[str, str] = {}
    for k, v in fields:
        headers.setdefault(k, v)
    size = int(headers.get("content-length", "0") or 0)
    block = text[m.end() : m.end() + size]
    http, payload = _split_http(block) if "application/http" in headers.get("content-type", "") else (None, block)
    software = next((v for k, v in _fields(block) if k == "software"), None) if headers.get("warc-type") == "warcinfo" else None
    row = {
        "type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "url": headers.get("warc-target-uri", "").strip("<>") or None, "date": headers.get("warc-date"),
        "concurrent_to": [v for k, v in fields if k == "warc-concurrent-to"], "software": software, "content_type": headers.get("content-type"),
        "digest": headers.get("warc-payload-digest"), "headers": list(headers.items()), "http_header": http, "payload": payload, "truncated": len(block) < size,
    }
    end = m.end() + size
    while text[end : end + 1] in (b"\r", b"\n"):
        end += 1
    return row, end


def _arc(text: bytes, at: int) -> tuple[dict, int] | None:
    m = _ARC_LINE.match(text, at)
    if not m:
        return None
    url, size = m[1].decode("utf-8", "replace"), int(m[5])
    block = text[m.end() : m.end() + size]
    filedesc = url.startswith("filedesc:")
    http, payload = _split_http(block)
    row = {
        "type": "warcinfo" if filedesc else None, "record_id": None, "url": url, "date": m[3].decode(), "concurrent_to": [], "software": None, "content_type": m[4].decode("utf-8", "replace"),
        "digest": None, "headers": [("ip", m[2].decode("utf-8", "replace"))], "http_header": http, "payload": payload, "truncated": len(block) < size,
    }
    end = m.end() + size
    while text[end : end + 1] in (b"\r", b"\n"):
        end += 1
    return row, end


def parse(path: str, content: bytes) -> Iterator[dict]:
    """The records of a file, in order, in linear time. A file that isn't an archive, or is damaged, gives
    the records before the damage and then one of type `error` at its place."""
    for number, row in enumerate(_with_requests(_records(path.rsplit("/", 1)[-1], content))):
        yield row | {"path": path, "number": number}


def _with_requests(rows: Iterator[dict]) -> Iterator[dict]:
    """Records with the method and body of the first POST or PUT request among the requests and metadata
    right after them that are concurrent to them; the run ends at the first one that isn't."""
    held: list[dict] = []  # a capture and what follows it up to the next one
    linked = False
    for row in rows:
        row |= {"request_method": None, "request_body": None}
        if row["type"] not in ("request", "metadata"):
            yield from held
            held, linked = [row], row["record_id"] is not None
            continue
        linked = linked and held[0]["record_id"] in row["concurrent_to"]
        m = _REQUEST.match(row["payload"] or b"") if linked and row["type"] == "request" and held[0]["request_method"] is None else None
        if m and m[1] in (b"POST", b"PUT"):
            end = _HEAD_END.search(row["payload"])
            held[0] |= {"request_method": m[1].decode(), "request_body": row["payload"][end.end() :].decode("latin-1") if end else ""}
        held.append(row)
    yield from held


def _records(name: str, content: bytes) -> Iterator[dict]:
    seen = False
    plain = content[:2] != b"\x1f\x8b"
    for position, length, text, cut in _members(content):
        if cut and not text.strip(b"\r\n\0"):
            yield _error(name, position, length)
            return
        at = 0
        while _PADDING.match(text, at).end() < len(text):
            found = _warc(text, at) or _arc(text, at)
            if not found:
                yield _error(name, position + at if plain else position, length - at if plain else length)
                return
            row, end = found
            row |= {"filename": name, "position": position + at if plain else position, "length": end - at if plain else length, "truncated": row["truncated"] or cut}
            yield row
            seen, at = True, end
    if not seen and content:
        yield _error(name, 0, len(content))


def _error(name: str, position: int, length: int) -> dict:
    return dict.fromkeys(_NAMES) | {"filename": name, "position": position, "length": length, "type": "error", "concurrent_to": [], "headers": [], "truncated": True}


def _batches(filename: str, content: bytes, rows: int = 500, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    part, n = [], 0
    for row in parse(filename, content):
        part.append(row)
        n += len(row["payload"] or b"")
        if len(part) >= rows or n >= size:
            yield pa.RecordBatch.from_pylist(part, _ARROW)
            part, n = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, _ARROW)


def parsed(files: DataFrame) -> DataFrame:
    """The records of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _batches(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_records(spark: SparkSession, path: str, glob: str = ARCHIVE_GLOB) -> DataFrame:
    """The records of all archives below a path, open ones (`.warc.gz.open`) included."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


class ArchiveDataSource(DataSource):
    """`spark.read.format("archive").load(path)` for paths that the executors can open; a partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file:")

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        top = Path(self.path)
        files = [top] if top.is_file() else sorted(p for p in top.rglob("*") if re.search(r"\.(warc|arc)(\.gz)?(\.open)?$", p.name))
        return [_File(str(p)) for p in files]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            yield from _batches(partition.path, f.read())
