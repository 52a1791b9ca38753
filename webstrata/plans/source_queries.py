"""Sources and sinks over archives and files made of the supplied tables."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.binary import is_gzip
from webstrata.operators import capture_index as I
from webstrata.operators import extract as X
from webstrata.plans.fixtures import Views
from webstrata.plans.registry import query
from webstrata.sources import archive, sinks, tables


def _record(kind: str, url: str, ident: str, date: str, block: bytes, content_type: str) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <urn:r:{ident}>\r\nWARC-Date: {date}\r\nContent-Type: {content_type}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _files(v: Views) -> DataFrame:
    """Archives (path, content) with a warcinfo, and a response for each of ten pages, a gzip member each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies = [], []
            for group, pages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                info = b"software: example 1.0\r\n"
                out = [gzip.compress(f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", mtime=0)]
                for p in pages:
                    html = p["html"].encode()
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html
                    out.append(gzip.compress(_record("response", p["url"], str(p["page_id"]), "2024-01-01T00:00:00Z", http, "application/http; msgtype=response"), mtime=0))
                names.append(f"part-{group:06d}.warc.gz")
                bodies.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(bodies, pa.binary())], ["path", "content"])

    pages = v.table("pages").groupBy(F.expr("page_id div 10").alias("g")).agg(F.array_sort(F.collect_list(F.struct("page_id", "url", "html"))).alias("pages"))
    return pages.mapInArrow(run, "path string, content binary")


@query("select page_id, url, strlen(html) as bytes, concat('part-', lpad(cast(page_id // 10 as varchar), 6, '0'), '.warc.gz') filename from pages")
def archive_records(v: Views) -> DataFrame:
    rows = archive.parsed(_files(v)).where("type = 'response'")
    return rows.select(F.regexp_extract("record_id", r"(\d+)", 1).cast("long").alias("page_id"), "url", F.length("payload").cast("long").alias("bytes"), "filename")


@query()
def cdx_lines(v: Views) -> DataFrame:
    return I.lines(I.captures(archive.parsed(_files(v)))).select("filename", "line")


_SHA1 = "(select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast(concat('0x', substr(sha1(html), 5 * (i // 4) + 1, 5)) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1), '' order by i) from range(32) r(i))"


@query(f"select regexp_replace(url, '#', '#') url, '20240101000000' date, 'text/html' mime, cast(200 as int) status, {_SHA1} digest from pages")
def archive_captures(v: Views) -> DataFrame:
    return I.captures(archive.parsed(_files(v))).select("url", "date", "mime", "status", "digest")


@query("select concat('part-', lpad(cast(page_id // 10 as varchar), 6, '0'), '.warc.gz') filename, count(*) records, timestamp '2024-01-01' start_time, 'example 1.0' software from pages group by page_id // 10")
def archive_statistics(v: Views) -> DataFrame:
    records = archive.parsed(_files(v))
    return I.statistics(records, I.captures(records)).select("filename", "records", "start_time", "software")


@query()
def archive_documents(v: Views) -> DataFrame:
    return X.documents(archive.parsed(_files(v))).drop("path").withColumn("links", F.to_json("links")).withColumn("h1", F.to_json("h1"))


@query("select concat('part-', lpad(cast(page_id // 10 as varchar), 6, '0'), '.warc.gz') filename, true gzip, 2 as state from pages group by page_id // 10")
def archive_file_check(v: Views) -> DataFrame:
    """Each file's signature, and the state that reading it gives: indexed, or in error."""
    files = _files(v)
    bad = archive.parsed(files).where("type = 'error'").select("filename").distinct().withColumn("bad", F.lit(True))
    return files.select(F.col("path").alias("filename"), is_gzip(F.col("content")).alias("gzip")).join(bad, "filename", "left").select("filename", "gzip", F.when(F.col("bad"), -2).otherwise(2).alias("state"))


@query("select concat('c', cast(doc_id % 20 as varchar)) path, lang as language, count(*) pages from documents group by all")
def language_archives(v: Views) -> DataFrame:
    """Language statistics from tar.gz files with a file of lines for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for languages in batch.column(1).to_pylist():
                raw = io.BytesIO()
                with tarfile.open(fileobj=raw, mode="w:gz") as tar:
                    for e in languages:
                        body = b"http://x/\n" * e["n"]
                        info = tarfile.TarInfo(f"buckets/{e['lang']}.txt")
                        info.size = len(body)
                        tar.addfile(info, io.BytesIO(body))
                bodies.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["path", "content"])

    counts = v.table("documents").groupBy(F.concat(F.lit("c"), (F.col("doc_id") % 20).cast("string")).alias("path"), "lang").agg(F.count("*").alias("n"))
    files = counts.groupBy("path").agg(F.collect_list(F.struct("lang", "n")).alias("l")).mapInArrow(run, "path string, content binary")
    return tables.language_lines(files)


@query("select id, coalesce(case when id % 3 = 0 then concat('blob:', cast(id as varchar)) end, case when id % 3 = 1 then concat('http://store/', filename) end, concat('/files/', filename)) place from warc")
def storage_locations(v: Views) -> DataFrame:
    k = F.col("id") % 3
    return v.warc.select("id", tables.location(F.when(k == 0, F.col("id")), F.when(k == 1, "http://store/"), F.col("filename"), F.concat(F.lit("/files/"), "filename")).alias("place"))


@query("select concat('/jobs/j', page_id % 5, '/', 20240101000000 + page_id, '/warcs/f', page_id, '.warc.gz') path, concat('j', page_id % 5) job, cast(20240101000000 + page_id as varchar) launch, page_id size from pages where page_id % 2 = 0")
def crawl_job_files(v: Views) -> DataFrame:
    p = F.col("page_id")
    folder = F.when(p % 2 == 0, "warcs").otherwise("logs")
    files = v.table("pages").select(F.concat(F.lit("/jobs/j"), (p % 5).cast("string"), F.lit("/"), (p + 20240101000000).cast("string"), F.lit("/"), folder, F.lit("/f"), p.cast("string"), F.lit(".warc.gz")).alias("path"), p.alias("size"))
    return tables.job_files(files)


@query("select concat('/jobs/j/', case page_id % 4 when 0 then 'state/x' when 1 then 'reports/r' when 2 then 'a.jdb' else 'crawler-beans.cxml' end) path from pages where page_id % 4 in (1, 3)")
def crawl_bundle_files(v: Views) -> DataFrame:
    k = F.col("page_id") % 4
    return tables.bundle_files(v.table("pages").select(F.concat(F.lit("/jobs/j/"), F.when(k == 0, "state/x").when(k == 1, "reports/r").when(k == 2, "a.jdb").otherwise("crawler-beans.cxml")).alias("path")))


@query("select concat('f', cast(page_id as varchar)) filename, strlen(html) size from pages")
def zip_manifest(v: Views) -> DataFrame:
    return sinks.zip_manifest(v.table("pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("filename"), F.col("html").cast("binary").alias("content"))).select("filename", "size")


@query("select id, case when id % 2 = 0 then null else filename end path, sha256(filename) sha256, case when id % 2 = 0 then id + 7 end blob_id from warc")
def blob_store_put(v: Views) -> DataFrame:
    files = v.warc.select("id", F.col("filename").alias("path"), F.sha2("filename", 256).alias("sha256"))
    stored = files.select("id", F.when(F.col("id") % 2 == 0, F.col("sha256")).otherwise("damaged").alias("sha256"), (F.col("id") + 7).alias("blob_id"))
    return sinks.stored_blobs(files, stored, delete_original=True)


@query("select page_id // 10 warc_id, count(*) n from pages group by 1")
def json_arrays(v: Views) -> DataFrame:
    """A JSON array of documents for each file, read again."""
    rows = v.table("pages").select(F.expr("page_id div 10").alias("warc_id"), F.col("page_id").alias("position"), "url")
    return sinks.json_documents(rows).select("warc_id", F.size(F.from_json("json", "array<struct<url:string>>")).cast("long").alias("n"))


@query("select page_id, case when page_id % 3 = 0 then null else page_id end meta_id from pages")
def cache_metadata(v: Views) -> DataFrame:
    p = F.col("page_id")
    value = F.when(p % 3 == 0, "{broken").otherwise(F.concat(F.lit('{"warcId":'), p.cast("string"), F.lit(',"size":1}')))
    return tables.cache_metadata(v.table("pages").select(p.cast("string").alias("path"), value.alias("value"))).select(F.col("path").cast("long").alias("page_id"), F.col("meta.warcId").alias("meta_id"))

