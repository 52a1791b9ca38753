import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from webstrata.operators import capture_index as I
from webstrata.operators import extract as X
from webstrata.sources import archive, sinks, tables


def warc(kind, url=None, date="2024-05-06T07:08:09Z", block=b"", ident="1", **extra):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:r:{ident}>", f"WARC-Date: {date}", f"Content-Length: {len(block)}"]
    lines += [f"WARC-Target-URI: {url}"] * (url is not None) + [f"{k.replace('_', '-')}: {v}" for k, v in extra.items()]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = {"Content_Type": "application/http; msgtype=response"}
PAGE = b"""<html><head><title>Bad  title &lt;</title><meta name="DC.description" content="about"><meta property="og:title" content="og"><base href="http://elsewhere.example/"><link rel=stylesheet href=subdir/style.css></head>
<body><h1>One <b>big</b>
heading</h1><p>Some text</p><a href="/x y#f" title=t>go</a><a href="DATA:x">no</a><a href="">no</a><img src="p.png" alt="pic"><h1></h1><script>no()</script></body></html>"""


def response(body, status="200 OK", headers=""):
    return f"HTTP/1.1 {status}\r\n{headers}\r\n".encode() + body


RECORDS = [
    warc("warcinfo", block=b"software: example 2.0\r\nformat: x\r\n", ident="0"),
    warc("response", "http://example.org/page", block=response(PAGE, headers="Content-Type: text/html; charset=utf-8\r\n"), ident="1", **HTTP),
    warc("request", "http://example.org/page", block=b"POST /page HTTP/1.1\r\n\r\nk=v", ident="2", WARC_Concurrent_To="<urn:r:1>", Content_Type="application/http; msgtype=request"),
    warc("response", "http://example.org/old", block=response(b"", "301 Moved", "Location: /new page\r\n"), ident="3", WARC_Payload_Digest="sha1:ABCDEF", **HTTP),
    warc("resource", "http://example.org/file.pdf", block=b"%PDF", ident="4", Content_Type="application/pdf"),
    warc("response", "http://example.org/early", date="1980-01-01T00:00:00Z", block=response(b"x"), ident="5", **HTTP),
    warc("response", "http://example.org/partial", block=b"HTTP/1.1 200 OK\r\n\r\n", ident="6", WARC_JSON_Metadata="{}", WARC_Page_ID="p", **HTTP),
    warc("revisit", "http://example.org/page", block=b"", ident="7"), warc("metadata", "http://example.org/page", block=b"a: b", ident="8", Content_Type="application/warc-fields"),
    warc("response", "dns:example.org", block=b"x", ident="9", Content_Type="text/dns"),
]
ARC = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 9\n1 0 Test\n\nhttp://arc.example/ 1.2.3.4 2001020304050600 text/html 41\nHTTP/1.0 200 OK\nContent-Type: text/x\n\nhi\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("archives")
    (top / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, RECORDS)))
    (top / "b.warc").write_bytes(b"".join(RECORDS))
    (top / "c.warc.gz.open").write_bytes(gzip.compress(RECORDS[1]))
    (top / "d.arc").write_bytes(ARC)
    (top / "e.warc.gz").write_bytes(b"not an archive")
    (top / "f.warc.gz").write_bytes(gzip.compress(RECORDS[1]) + gzip.compress(RECORDS[3])[:40])
    (top / "g.warc.gz").write_bytes(b"")
    (top / "notes.txt").write_text("no")
    return top


def test_records(spark, folder):
    rows = archive.read_records(spark, str(folder)).orderBy("filename", "position").collect()
    by = {}
    for r in rows:
        by.setdefault(r.filename, []).append(r)
    assert [len(by[n]) for n in ("a.warc.gz", "b.warc", "c.warc.gz.open", "d.arc", "e.warc.gz")] == [10, 10, 1, 2, 1]
    a, b = by["a.warc.gz"], by["b.warc"]
    assert [r.payload for r in a] == [r.payload for r in b] and a[0].software == "example 2.0"
    raw = (folder / "a.warc.gz").read_bytes()
    for r, whole in zip(a, RECORDS):
        assert gzip.decompress(raw[r.position : r.position + r.length]) == whole
    raw = (folder / "b.warc").read_bytes()
    assert [raw[r.position : r.position + r.length] for r in b] == RECORDS
    assert by["d.arc"][1].url == "http://arc.example/" and by["d.arc"][1].date == "2001020304050600"
    assert by["e.warc.gz"][0].type == "error"
    assert [r.type for r in by["f.warc.gz"]] == ["response", "error"]


def test_data_source_gives_the_same_rows(spark, folder):
    spark.dataSource.register(archive.ArchiveDataSource)
    columns = ["filename", "position", "length", "type", "url"]
    own = spark.read.format("archive").load(str(folder)).select(columns).collect()
    assert sorted(map(tuple, own), key=str) == sorted(map(tuple, archive.read_records(spark, str(folder)).select(columns).collect()), key=str)


def test_captures_and_lines(spark, folder):
    records = archive.read_records(spark, str(folder), "a.warc.gz")
    found = {r.url: r for r in I.captures(records).collect()}
    assert set(found) == {"http://example.org/page", "http://example.org/old", "http://example.org/file.pdf"}
    page, old, pdf = (found[f"http://example.org/{x}"] for x in ("page", "old", "file.pdf"))
    assert page.urlkey == "(org,example,)/page?__method=POST&k=v" and (page.date, page.mime, page.status) == ("20240506070809", "text/html", 200)
    assert (old.digest, old.status, old.redirect) == ("ABCDEF", 301, "http://example.org/new page") and (pdf.mime, pdf.status) == ("application/pdf", 200)
    lines = [r.line.split(" ") for r in I.lines(I.captures(records)).collect()]
    assert all(len(x) == 11 and x[7] == "-" for x in lines) and {x[6] for x in lines} == {"-", "http://example.org/new%20page"}
    stats = I.statistics(records, I.captures(records)).collect()
    assert [(s.records, s.software, s.record_bytes) for s in stats] == [(3, "example 2.0", page.length + old.length + pdf.length)]
    arc = I.captures(archive.read_records(spark, str(folder), "d.arc")).collect()
    assert [(r.url, r.date) for r in arc] == [("http://arc.example/", "20010203040506")]


def test_documents(spark, folder):
    docs = {r.url: r for r in X.documents(archive.read_records(spark, str(folder), "a.warc.gz")).where("content_type is null or content_type <> 'application/warc-fields'").collect()}
    page = docs["http://example.org/page"]
    assert (page.title, page.description, page.og_title, page.h1, page.text_error) == ("Bad title <", "about", "og", ["One big heading"], None)
    assert "Some text" in page.text and "no()" not in page.text
    links = {(x.type, x.url, x.text, x.title, x.rel) for x in page.links}
    assert links == {("link", "http://example.org/subdir/style.css", None, None, "stylesheet"), ("a", "http://example.org/x%20y", "go", "t", None), ("img", "http://example.org/p.png", "pic", None, None)}
    assert [x.type for x in docs["http://example.org/old"].links] == ["location"] and docs["http://example.org/file.pdf"].text_error == "no extractor for content-type"
    assert page.site == "example.org" and page.status_code == 200


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([(5, "a 1"), (1500, "b 2"), (1500, "@alias c d")], "warc_id long, line string")
    sinks.write_index_lines(lines, str(tmp_path / "cdx"))
    back = spark.read.text(str(tmp_path / "cdx"))
    assert sorted((r.value, str(r.bucket)) for r in back.collect()) == [("@alias c d", "1"), ("a 1", "0"), ("b 2", "1")]
    assert [r.line for r in sinks.remaining(lines.select("line"), lines.where("warc_id = 1500").select("line")).collect()] == ["a 1", "@alias c d"]
    sinks.write_documents(lines, str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 3
    sinks.write_lines(lines.select("warc_id"), str(tmp_path / "ids"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["1500", "1500", "5"]


def test_publish(spark, tmp_path):
    target = str(tmp_path / "posted")

    def send(url, body):
        with open(target, "a") as f:
            f.write(body)

    assert sinks.publish(spark.createDataFrame([(f"l{i}",) for i in range(25)], "line string").coalesce(1), "http://index", send, 10) == 25
    assert sorted(open(target).read().split()) == sorted(f"l{i}" for i in range(25))


def test_language_and_zip_files(spark, tmp_path):
    with tarfile.open(tmp_path / "x-language-buckets.tar.gz", "w:gz") as tar:
        for name, n in (("en", 3), ("kr", 2)):
            body = b"http://x/\xe9\n" * n
            info = tarfile.TarInfo(f"buckets/{name}.txt")
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one/two.txt", "x")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted((r.language, r.pages) for r in tables.language_lines(files.where("path like '%.tar.gz'")).collect()) == [("en", 3), ("kr", 2)]
    assert [r.entry for r in tables.zip_entries(files.where("path like '%.zip'")).collect()] == ["one/two.txt"]
    m = {r.filename: r for r in tables.manifest(spark, str(tmp_path)).collect()}
    assert m["x-language-buckets.tar.gz"].gzip and not m["b.zip"].gzip and len(m["b.zip"].sha256) == 64


def test_json_sources(spark, tmp_path):
    (tmp_path / "docs.json").write_text('[{"url": "a", "n": 1}, {"url": "b"}]')
    assert sorted((r.url, r.n) for r in tables.cached_documents(spark, str(tmp_path / "docs.json"), "url string, n long").collect()) == [("a", 1), ("b", None)]
    entries = spark.createDataFrame([("p", '{"warcId": 3, "size": 4}'), ("q", "{bro"), ("r", None)], "path string, value string")
    assert {r.path: r.meta and r.meta.warcId for r in tables.cache_metadata(entries).collect()} == {"p": 3, "q": None, "r": None}


def test_jobs(spark):
    from datetime import datetime

    files = spark.createDataFrame([("/j/a/20240101000000/warcs/x.warc.gz", datetime(2024, 1, 1)), ("/j/b/20240102000000/logs/x.log", datetime(2024, 1, 2))], "path string, modified timestamp").withColumn("size", F.lit(1))
    assert [r.job for r in tables.jobs(files).collect()] == ["b", "a"]
    assert [(r.job, r.launch) for r in tables.job_files(files).collect()] == [("a", "20240101000000")]


def test_equal_base_names(spark):
    """Two files of one name in two folders are two files: for documents, requests and statistics."""
    from webstrata.operators import extract as X

    def record(kind, ident, block, more=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://x.y/{ident}\r\nWARC-Record-ID: <urn:r:1{kind}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n{more}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    page = lambda n: record("response", n, f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<title>t{n}</title>".encode())
    post = record("request", "b", b"POST /b HTTP/1.1\r\n\r\nq=1", "WARC-Concurrent-To: <urn:r:1response>\r\n")
    files = spark.createDataFrame([("/a/x.warc.gz", gzip.compress(page("a"))), ("/b/x.warc.gz", gzip.compress(page("b")) + gzip.compress(post))], "path string, content binary")
    records = archive.parsed(files)
    found = X.documents(records)
    assert sorted((r.path, r.title) for r in found.collect()) == [("/a/x.warc.gz", "ta"), ("/b/x.warc.gz", "tb")]
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("MapInArrow") > 0
    assert sorted((r.path, r.records) for r in I.statistics(records, I.captures(records)).collect()) == [("/a/x.warc.gz", 1), ("/b/x.warc.gz", 1)]
    assert sorted((r.path, r.number, r.request_method, r.request_body) for r in records.collect()) == [("/a/x.warc.gz", 0, None, None), ("/b/x.warc.gz", 0, "POST", "q=1"), ("/b/x.warc.gz", 1, None, None)]


def test_plain_archives_take_linear_time():
    import time

    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 1000\r\n\r\n" + b"x" * 1000 + b"\r\n\r\n"
    begin = time.process_time()
    assert sum(1 for _ in archive.parse("/a/b.warc", one * 30_000 + b"\0" * 100_000)) == 30_000
    assert time.process_time() - begin < 10
