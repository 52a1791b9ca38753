import pytest
from pyspark.sql import functions as F

from webstrata.functions import binary as B
from webstrata.functions import dates as D
from webstrata.functions import text as T
from webstrata.functions import urls as U

PREFIX = "http://archive.example/pan/"


def values(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.v for r in rows.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_display_size(spark):
    assert values(spark, T.display_size, [-10000000, 10000000, 3521675312675137, 1023, 1024, 0], "long") == ["-9.5 MiB", "9.5 MiB", "3.1 PiB", "1023 bytes", "1.0 KiB", "0 bytes"]


def test_schemes(spark):
    assert values(spark, U.remove_scheme, ["http://www.example.org", "www.example.org", "a1://x"]) == ["www.example.org", "www.example.org", "a1://x"]
    assert values(spark, U.add_implicit_scheme, ["example.org", "https://x", "http:/x"]) == ["http://example.org", "https://x", "http:/x"]


def test_surt(spark):
    assert values(spark, lambda c: U.host_surt(U.host(c)), ["http://example.org", "https://example.org"]) == ["(org,example,", "(org,example,"]
    assert values(spark, U.surt, ["https://www.Example.org:80/a?b#c", "www2.x.y", "http://u@x.y?q", None]) == ["(org,example,)/a?b", "(y,x,)/", "(y,x,)/?q", None]
    assert values(spark, U.comparison_key, ["http://X.y/a/", "x.y/A", "http://x.y/", ""]) == ["(y,x,)/a", "(y,x,)/a", "(y,x,)", None]


def test_sites(spark):
    assert values(spark, U.site, ["http://a.b.example.com/x", "http://www.nsw.gov.au/", "http://www3.localhost/", "http://1.2.3.4/", ""]) == ["example.com", "nsw.gov.au", "www3.localhost", "1.2.3.4", ""]


def test_clean_url(spark):
    assert values(spark, U.clean_url, ["HTTP://Ex.org:80/a b#c", "https://x.y:443", "x y#z", "http://x/\r\n"]) == ["http://ex.org/a%20b", "https://x.y/", "x%20y", "http://x/%0d%0a"]


def test_resolve(spark):
    rows = spark.createDataFrame([("http://a.b/c/d", "../e"), ("http://a.b/c/d", "?q"), ("http://a.b", "http://[bad"), (None, "x")], "b string, x string")
    assert [r.v for r in rows.select(U.resolve(F.col("b"), F.col("x")).alias("v")).collect()] == ["http://a.b/e", "http://a.b/c/d?q", None, None]


def test_archive_prefix(spark):
    urls = [PREFIX + "10075/20001212-0000/www.paper.example/a.html", PREFIX + "1/2/x", "http://other/"]
    assert values(spark, lambda c: U.original_url(c, PREFIX), urls) == ["http://www.paper.example/a.html", urls[1], urls[2]]
    assert values(spark, lambda c: U.is_recursive(c, PREFIX), [PREFIX + "1/2/archive.example/pan/3", PREFIX + "1/2/x.y/"], "string") == [True, False]
    assert values(spark, lambda c: U.url_map_instance(c, PREFIX), [PREFIX + "12/2000-01/url.map", PREFIX + "12/url.map"]) == ["12/2000-01", ""]


def test_request_keys(spark):
    rows = spark.createDataFrame([("http://x.y/a", "GET", None), ("http://x.y/a", "POST", "k=v"), ("http://x.y/a?b", "PUT", "")], "u string, m string, b string")
    assert [r.v for r in rows.select(U.request_key(F.col("u"), F.col("m"), F.col("b")).alias("v")).collect()] == ["(y,x,)/a", "(y,x,)/a?__method=POST&k=v", "(y,x,)/a?b&__method=PUT"]


def test_url_map_aliases(spark):
    body = "http://a.b/x^^/5/20010101-0000/a.b/x\nc.d/y^^m/y.html\nbroken\nhttp://nodots/^^z"
    rows = U.map_aliases(spark.createDataFrame([("5/20010101-0000", body)], "instance string, body string"), PREFIX).collect()
    base = PREFIX + "5/20010101-0000/"
    assert sorted((r.alias, r.target, r.kind) for r in rows) == sorted([(base + "a.b/x", "http://a.b/x", "primary"), (base + "m/y.html", "http://c.d/y", "primary"), (base + "c.d/y", "http://c.d/y", "secondary")])


def test_status_lines(spark):
    assert values(spark, T.status_code, ["HTTP/1.0 200 test", "HTTP/1.0 200\r\n", "HTTP/1.0 200\r", "HTTP/1.0 200", "HTTP/1.0    500  something wacky\r", "x", "HTTP/1.0 99999999999"]) == [200, 200, 200, 200, 500, -1, -1]


def test_headers(spark):
    [h] = values(spark, T.headers, ["HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A:  1:2 \r\nx-a: second\r\n"])
    assert h == {"content-type": "text/html", "x-a": "1:2"}
    assert values(spark, T.is_brotli, ["gzip, BR", "brotli", None]) == [True, False, False]


def test_content_types(spark):
    assert values(spark, T.content_type, ["text/html; charset=x", "application/xhtml+xml", "application/x-pdf ;q", "text/plain x"]) == ["text/html", "text/html", "application/pdf", "text/plain"]


def test_byte_ranges(spark):
    rows = [("bogus", 10), ("bytes=", 10), ("bytes=1-2,2-3,-4", 10), ("bytes=10-999", 140), ("bytes=10-", 10), ("bytes=-50", 10), ("bytes=5-3", 10)]
    got = [r.v for r in spark.createDataFrame(rows, "h string, n long").select(T.byte_ranges(F.col("h"), F.col("n")).alias("v")).collect()]
    assert [None if v is None else [tuple(x) for x in v] for v in got] == [None, None, [(1, 2), (2, 3), (6, 9)], [(10, 139)], None, [(0, 9)], None]


def test_spaces(spark):
    assert values(spark, T.collapse_space, ["\n a  b\nc\t\td \x00", None]) == ["a b\nc d", None]
    assert values(spark, T.heading_text, [" a \n b "]) == ["a b"]


def test_task_texts(spark):
    assert values(spark, T.task_name, ["CdxIndexer"]) == ["Cdx Indexer"]
    assert values(spark, T.duration, [3723, 61, 5], "long") == ["1h 2m 3s", "1m 1s", "5s"]


def test_dates(spark):
    assert values(spark, D.repair, ["2000092900480050", "200008311500550015", "200009290048", "1999111111111111", "20000929004850", ""]) == ["20000929004850", "20000831155515", "20000929004800", "19991111111111", "20000929004850", ""]
    assert values(spark, D.to_arc_date, ["2000-09-29T00:48:50Z", "2026-07-07T14:00:15.998Z", "20000929004850", "x"]) == ["20000929004850", "20260707140015", "20000929004850", None]


def test_sync_tokens(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' t union all select timestamp_ntz'2024-01-02 03:04:05.120'")
    got = [r.v for r in rows.select(D.sync_token(F.col("t"), F.lit(7)).alias("v")).collect()]
    assert got == ["2024-01-02T03:04:05Z,7", "2024-01-02T03:04:05.12Z,7"]
    back = [r.v for r in spark.createDataFrame([(x,) for x in [*got, "junk"]], "x string").select(D.parse_sync_token(F.col("x")).alias("v")).collect()]
    assert back[1].time.microsecond == 120000 and back[0].warc_id == 7 and back[2].time is None and back[2].warc_id is None


@pytest.mark.parametrize("raw,gzip", [(b"", False), (b"\x01", False), (b"\x01\x02", False), (b"\x01\x02\x03", False), (b"\x1f\x8b\x03", True)])
def test_gzip_signature(spark, raw, gzip):
    assert values(spark, B.is_gzip, [bytearray(raw)], "binary") == [gzip]


def test_digests(spark):
    import base64
    import hashlib

    for raw in (b"", b"abc", bytes(range(256))):
        assert values(spark, B.sha1_base32, [bytearray(raw)], "binary") == [base64.b32encode(hashlib.sha1(raw).digest()).decode()]
    assert values(spark, B.digest_header, [hashlib.sha256(b"x").hexdigest()]) == ["sha-256=" + base64.b64encode(hashlib.sha256(b"x").digest()).decode()]
    assert values(spark, B.digest_of_header, ["sha1:ABC", "ABC"]) == ["ABC", "ABC"]


def test_damage(spark):
    head = "HTTP/1.0 200 OK\r\n"
    texts = ["DELETED_TIME=2", "500 (Internal", "HTTP/1.0 404 a: b\n", head, *("x" * (k * 1024) + head for k in (1, 2, 4, 8)), "\n<html>x", "x" * 3072 + head, "short"]
    expected = ["DELETED", "FAKE_500", "COLON_IN_HTTP_STATUS", "UNKNOWN", *(f"JUNK_{k}KB_BEFORE_HEADER" for k in (1, 2, 4, 8)), "NO_HTTP_HEADER", "UNKNOWN", "UNKNOWN"]
    assert values(spark, B.damage, texts) == expected
    assert values(spark, B.aligned_header, texts) == [0, 0, 0, 0, 1024, 2048, 4096, 8192, 0, 3072, 0]
    assert values(spark, lambda c: B.shorter_header(c, F.lit(10)), ["http://x 1.1.1.1 2000 text/html 110\n"]) == ["http://x 1.1.1.1 2000 text/html 100\n"]
