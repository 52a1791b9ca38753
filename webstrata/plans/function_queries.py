"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions import binary as B
from webstrata.functions import dates as D
from webstrata.functions import text as T
from webstrata.functions import urls as U
from webstrata.operators.capture_index import indexable, record_kind
from webstrata.plans.fixtures import Views
from webstrata.plans.registry import query

PREFIX = "http://archive.example/pan/"
_HOST = "lower(regexp_extract(url, '://([^/?#:]+)', 1))"


@query("""select page_id, case when regexp_matches(u, '^[a-zA-Z][a-zA-Z+.-]*://?') then u else concat('http://', u) end implied, regexp_replace(u, '^[a-zA-Z][a-zA-Z+.-]*://?', '') bare
    from (select page_id, case when page_id % 2 = 0 then url else regexp_replace(url, '^https?://', '') end u from pages)""")
def url_scheme_ops(v: Views) -> DataFrame:
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return v.table("pages").select("page_id", U.add_implicit_scheme(u).alias("implied"), U.remove_scheme(u).alias("bare"))


@query(f"select page_id, {_HOST} host from pages")
def url_host(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", U.host(F.col("url")).alias("host"))


@query(f"""select page_id, concat('(', array_to_string(list_reverse(string_split(regexp_replace({_HOST}, '^www[0-9]*\\.', ''), '.')), ','), ',)', regexp_extract(url, '://[^/?#]*([^#]*)', 1)) surt from pages""")
def url_surt(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", U.surt(F.col("url")).alias("surt"))


@query(f"select page_id, array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.') site from pages")
def url_site(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", U.site(F.col("url")).alias("site"))


@query("select page_id, 's' || page_id || case page_id % 5 when 0 then '.com.au' when 1 then '.co.uk' when 2 then '.com.sg' when 3 then '.lib.example.us' else '.org' end site from pages")
def url_site_by_suffix(v: Views) -> DataFrame:
    """Sites below suffixes of one, two and three labels, with a list of suffixes of the caller's."""
    p = F.col("page_id")
    suffix = F.when(p % 5 == 0, ".com.au").when(p % 5 == 1, ".co.uk").when(p % 5 == 2, ".com.sg").when(p % 5 == 3, ".lib.example.us").otherwise(".org")
    url = F.concat(F.lit("https://www.Inner.s"), p.cast("string"), suffix, F.lit("/a.co.uk"))
    return v.table("pages").select("page_id", U.site(url, {*U.TWO_LABEL_SUFFIXES, "com.sg", "lib.example.us"}).alias("site"))


@query("select page_id, regexp_replace(url, '#.*', '') url from pages")
def url_clean(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", U.clean_url(F.concat(F.upper(F.substring_index("url", "://", 1)), F.lit("://"), F.substring_index("url", "://", -1))).alias("url"))


@query("select page_id, case when page_id % 3 = 0 then url else regexp_replace(url, '^https?://', 'http://') end url from pages")
def url_archive_prefix_removed(v: Views) -> DataFrame:
    served = F.concat(F.lit(PREFIX), F.col("page_id").cast("string"), F.lit("/20010101-0000/"), U.remove_scheme(F.col("url")))
    return v.table("pages").select("page_id", U.original_url(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(served), PREFIX).alias("url"))


@query("select page_id, page_id % 2 = 0 recursive, case when page_id % 2 = 0 then '' else concat(cast(page_id as varchar), '/20010101-0000') end instance from pages")
def url_archive_tests(v: Views) -> DataFrame:
    own = F.concat(F.lit(PREFIX), F.col("page_id").cast("string"), F.lit("/20010101-0000/"))
    url = F.concat(own, F.when(F.col("page_id") % 2 == 0, "archive.example/pan/7").otherwise("url.map"))
    return v.table("pages").select("page_id", U.is_recursive(url, PREFIX).alias("recursive"), U.url_map_instance(url, PREFIX).alias("instance"))


@query(f"select page_id, contains({_HOST}, '.') sane from pages")
def url_sane(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", U.sane(F.col("url")).alias("sane"))


@query("select page_id, case page_id % 4 when 3 then '5/20020202-0000/x.html' else 'example.org/x.html' end path from pages")
def url_mirror_paths(v: Views) -> DataFrame:
    k = F.col("page_id") % 4
    instance = F.lit("5/20010101-0000")
    path = F.when(k == 0, "/5/20010101-0000/example.org/x.html").when(k == 1, "5/20010101/example.org/x.html").when(k == 2, "example.org/x.html").otherwise("5/20020202-0000/x.html")
    return v.table("pages").select("page_id", U.mirror_path(path, instance).alias("path"))


_MAP = f"select concat(cast(page_id % 10 as varchar), '/20010101-0000') instance, regexp_replace(url, '#.*', '') target, regexp_replace(regexp_replace(url, '^https?://', ''), '#.*', '') p, page_id from pages"


@query(f"""select instance, concat('{PREFIX}', instance, '/', case when page_id % 2 = 0 then p else concat('m/', p) end) alias, target, 'primary' kind from ({_MAP})
    union all select instance, concat('{PREFIX}', instance, '/', p), target, 'secondary' from ({_MAP}) where concat('{PREFIX}', instance, '/', p) not in (select concat('{PREFIX}', instance, '/', case when page_id % 2 = 0 then p else concat('m/', p) end) from ({_MAP}))""")
def url_aliases(v: Views) -> DataFrame:
    path = U.remove_scheme(F.col("url"))
    line = F.concat("url", F.lit("^^"), F.when(F.col("page_id") % 2 == 0, path).otherwise(F.concat(F.lit("/m/"), path)))
    maps = v.table("pages").groupBy(F.concat((F.col("page_id") % 10).cast("string"), F.lit("/20010101-0000")).alias("instance")).agg(F.concat_ws("\n", F.collect_list(line)).alias("body"))
    return U.map_aliases(maps, PREFIX)


@query(f"select concat('f', cast(page_id % 7 as varchar)) filename, concat('{PREFIX}', cast(page_id as varchar), '/20010101/a/') alias, concat('{PREFIX}', cast(page_id as varchar), '/20010101/a/index.html') target from pages where page_id % 7 <> 3 and page_id % 2 = 0")
def index_page_aliases(v: Views) -> DataFrame:
    name = F.when((F.col("page_id") % 7 == 3) & (F.col("page_id") % 2 == 1), "url.map").when(F.col("page_id") % 2 == 0, "a/index.html").otherwise("a/x.html")
    records = v.table("pages").select(F.concat(F.lit("f"), (F.col("page_id") % 7).cast("string")).alias("filename"), F.concat(F.lit(PREFIX), F.col("page_id").cast("string"), F.lit("/20010101/"), name).alias("url"))
    return U.index_page_aliases(records, PREFIX)


@query("select page_id, replace(replace(url, '&', '&amp;'), regexp_extract(url, '://([^/?#:]+)', 1), concat('<strong>', regexp_extract(url, '://([^/?#:]+)', 1), '</strong>')) html from pages")
def url_highlighted(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", U.highlighted(F.col("url")).alias("html"))


@query("select p_partkey, substr(p_name, 1, instr(p_name, ' ') - 1) head, array_to_string(list_slice(string_split(p_name, ' '), -1, -1), ' ') tail from part where instr(p_name, ' ') > 0")
def substring_index(v: Views) -> DataFrame:
    return v.table("part").where(F.instr("p_name", " ") > 0).select("p_partkey", F.substring_index("p_name", " ", 1).alias("head"), F.substring_index("p_name", " ", -1).alias("tail"))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[ \t\n\x0B\f\r]{2,}', ' ', 'g')) digest from documents")
def text_collapsed(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(T.collapse_space(F.col("text"))).alias("digest"))


@query("select doc_id, md5(replace(replace(text, ' ', '%20'), chr(10), '%0A')) digest from documents")
def index_escaped(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(T.index_escape(F.col("text"))).alias("digest"))


@query("select p_partkey, case p_size % 4 when 0 then 'text/html' when 1 then 'application/pdf' when 2 then 'image/png' else 'text/plain' end type, case p_size % 4 when 2 then 'not implemented for content-type' when 3 then 'not implemented for content-type' end text_error from part")
def content_type_clean(v: Views) -> DataFrame:
    k = F.col("p_size") % 4
    header = F.when(k == 0, "application/xhtml+xml; charset=utf-8").when(k == 1, "application/x-pdf").when(k == 2, "image/png ;a=b").otherwise("text/plain x")
    return v.table("part").select("p_partkey", T.content_type(header).alias("type"), T.text_error(T.content_type(header)).alias("text_error"))


@query("select p_partkey, cast(case p_size % 3 when 0 then 200 + p_size when 1 then 500 else -1 end as int) status from part")
def status_line(v: Views) -> DataFrame:
    k = F.col("p_size") % 3
    line = F.when(k == 0, F.concat(F.lit("HTTP/1.0 "), (F.col("p_size") + 200).cast("string"), F.lit(" OK\r\n"))).when(k == 1, "HTTP/1.0    500  something wacky\r").otherwise("HTTP/1.0 none")
    return v.table("part").select("p_partkey", T.status_code(line).alias("status"))


@query("""select p_partkey, case p_size % 4 when 0 then concat(p_partkey, '-', p_partkey + 999, ' ', p_partkey + 5000, '-', p_partkey + 9999) when 1 then concat(p_partkey + 10000 - 500, '-', p_partkey + 9999) when 2 then concat('5-', p_partkey + 9999) end ranges from part""")
def byte_ranges(v: Views) -> DataFrame:
    n, k = F.col("p_partkey"), F.col("p_size") % 4
    text = lambda c: c.cast("string")
    header = F.when(k == 0, F.concat(F.lit("bytes="), text(n), F.lit("-"), text(n + 999), F.lit(","), text(n + 5000), F.lit("-9999999"))).when(k == 1, "bytes=-500").when(k == 2, "bytes=5-").otherwise("bogus")
    found = T.byte_ranges(header, n + 10000)
    return v.table("part").select("p_partkey", F.array_join(F.transform(found, lambda r: F.concat(text(r["first"]), F.lit("-"), text(r["last"]))), " ").alias("ranges"))


@query("""select id, case when size < 1024 then concat(size, ' bytes') when size <= 1048576 then concat((size * 20 + 1024) // 20480, '.', (size * 20 + 1024) // 2048 % 10, ' KiB')
    else concat((size // 1024 * 20 + 1024) // 20480, '.', (size // 1024 * 20 + 1024) // 2048 % 10, ' MiB') end shown from warc""")
def display_size(v: Views) -> DataFrame:
    return v.warc.select("id", T.display_size(F.col("size")).alias("shown"))


@query("select id, case when ends_with(relpath, '.log') then 'LOG' when ends_with(relpath, '.cxml') then 'CONFIG' when ends_with(relpath, '.recover.gz') then 'RECOVER' when ends_with(relpath, '.dump') then 'DUMP' else 'UNKNOWN' end type, case when ends_with(relpath, '.cxml') then 'application/xml' when ends_with(relpath, '.log') or ends_with(relpath, '.dump') then 'text/plain' else 'application/octet-stream' end content_type from artifact")
def artifact_types(v: Views) -> DataFrame:
    p = F.col("relpath")
    return v.artifact.select("id", T.artifact_type(p).alias("type"), T.artifact_content_type(p).alias("content_type"))


@query("select p_partkey, case p_size % 3 when 0 then 'first' when 1 then 'second x' end description from part")
def meta_property(v: Views) -> DataFrame:
    k = F.col("p_size") % 3
    meta = F.when(k == 0, F.create_map(F.lit("DC.description"), F.lit("other"), F.lit("description"), F.lit(" first "))).when(k == 1, F.create_map(F.lit("dcterms.description"), F.lit("second  x"))).otherwise(F.create_map(F.lit("a"), F.lit("b")))
    return v.table("part").select("p_partkey", T.property_of(meta, "description").alias("description"))


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') arc_date, o_orderdate parsed from orders")
def date_conversion(v: Views) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return v.table("orders").select("o_orderkey", D.to_arc_date(iso).alias("arc_date"), D.parse_arc_date(D.to_arc_date(iso)).cast("timestamp_ntz").alias("parsed"))


@query("select o_orderkey, case o_orderkey % 3 when 2 then '20110705003122' when 1 then strftime(o_orderdate, '%Y%m%d%H%M%S') else concat(strftime(o_orderdate, '%Y%m%d%H%M'), '00') end repaired from orders")
def date_repair(v: Views) -> DataFrame:
    """Whole dates, dates without seconds, and one with one `00` or two too many."""
    k = F.col("o_orderkey") % 3
    damaged = F.when(F.col("o_orderkey") % 6 == 5, "201107050000310022").when(k == 2, "2011070500310022").when(k == 1, F.date_format("o_orderdate", "yyyyMMddHHmmss")).otherwise(F.date_format("o_orderdate", "yyyyMMddHHmm"))
    return v.table("orders").select("o_orderkey", D.repair(damaged).alias("repaired"))


@query("select id, concat(strftime(time, '%Y-%m-%dT%H:%M:%S'), case when microsecond(time) % 1000000 = 0 then '' else concat('.', rtrim(lpad(cast(microsecond(time) % 1000000 as varchar), 6, '0'), '0')) end, 'Z,', cast(warc_id as varchar)) token, time, warc_id from warc_history")
def sync_tokens(v: Views) -> DataFrame:
    token = D.sync_token(F.col("time"), F.col("warc_id"))
    parsed = D.parse_sync_token(token)
    return v.warc_history.select("id", token.alias("token"), parsed["time"].alias("time"), parsed["warc_id"].alias("warc_id"))


@query("select page_id, sha256(html) sha256, concat('sha-256=', to_base64(unhex(sha256(html)))) header from pages")
def page_digests(v: Views) -> DataFrame:
    d = B.sha256_hex(F.col("html").cast("binary"))
    return v.table("pages").select("page_id", d.alias("sha256"), B.digest_header(d).alias("header"))


@query("""select page_id, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast(concat('0x', substr(h, 5 * (i // 4) + 1, 5)) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1), '' order by i) from range(32) r(i)) sha1 from (select page_id, sha1(html) h from pages)""")
def page_sha1_base32(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", B.sha1_base32(F.col("html").cast("binary")).alias("sha1"))


@query("select page_id, page_id % 2 = 0 gzip, case when page_id % 2 = 0 then concat('f', page_id, '.WARC.gz') else concat('f', page_id, '.WARC') end name from pages")
def gzip_names(v: Views) -> DataFrame:
    content = F.when(F.col("page_id") % 2 == 0, F.unhex(F.lit("1f8b03"))).otherwise(F.unhex(F.lit("01")))
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit(".WARC"))
    return v.table("pages").select("page_id", B.is_gzip(content).alias("gzip"), B.gzip_name(name, B.is_gzip(content)).alias("name"))


@query("""select page_id, case page_id % 7 when 0 then 'DELETED' when 1 then 'FAKE_500' when 2 then 'COLON_IN_HTTP_STATUS' when 3 then 'JUNK_1KB_BEFORE_HEADER' when 4 then 'JUNK_8KB_BEFORE_HEADER' when 5 then 'NO_HTTP_HEADER' else 'UNKNOWN' end damage,
    case page_id % 7 when 0 then 'discard' when 1 then 'discard' when 2 then 'replace_colon' when 3 then 'trim_junk' when 4 then 'trim_junk' else 'copy' end as action, cast(case page_id % 7 when 3 then 1024 when 4 then 8192 else 0 end as int) as offset from pages""")
def damage_classification(v: Views) -> DataFrame:
    head = "HTTP/1.0 200 OK\r\n"
    kinds = [F.lit("DELETED_TIME=2000"), F.lit("500 (Internal Server Error)"), F.lit("HTTP/1.0 404 Not Found: x\n"), F.concat(F.repeat(F.lit("x"), 1024), F.lit(head)), F.concat(F.repeat(F.lit("x"), 8192), F.lit(head)), F.lit("\r\n<html>"), F.lit("something")]
    content = F.element_at(F.array(*kinds), (F.col("page_id") % 7 + 1).cast("int"))
    found = B.damage(content)
    return v.table("pages").select("page_id", found.alias("damage"), B.repair_action(found).alias("action"), B.aligned_header(content).alias("offset"))


@query("select case page_id % 3 when 0 then 'discard' when 1 then 'trim_junk' else 'copy' end as action, count(*) n from pages group by 1")
def repair_counters(v: Views) -> DataFrame:
    damage = F.element_at(F.array(F.lit("DELETED"), F.lit("JUNK_2KB_BEFORE_HEADER"), F.lit("UNKNOWN")), (F.col("page_id") % 3 + 1).cast("int"))
    return v.table("pages").groupBy(B.repair_action(damage).alias("action")).agg(F.count("*").alias("n"))


@query("select page_id, concat('http://x 1.2.3.4 20000101000000 text/html ', cast(page_id + 1000 as varchar), chr(10)) header from pages")
def header_lengths_fixed(v: Views) -> DataFrame:
    header = F.concat(F.lit("http://x 1.2.3.4 20000101000000 text/html "), (F.col("page_id") + 2024).cast("string"), F.lit("\n"))
    return v.table("pages").select("page_id", B.shorter_header(header, F.lit(1024)).alias("header"))


@query("select cast(p_partkey as bigint) id, case when p_size % 2 = 0 then 'Cdx Indexer' else 'Watch Importer' end name from part")
def task_names(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("id"), T.task_name(F.when(F.col("p_size") % 2 == 0, "CdxIndexer").otherwise("WatchImporter")).alias("name"))


@query("select l_orderkey warc_id, l_linenumber record_no, l_partkey, l_suppkey, l_returnflag <> 'N' and l_quantity > 5 and l_shipdate >= timestamp '1996-01-01' indexed from lineitem")
def capture_filter(v: Views) -> DataFrame:
    """Which records are indexed, over columns made of line items."""
    rows = v.table("lineitem").select(
        F.col("l_orderkey").alias("warc_id"), F.col("l_linenumber").alias("record_no"), "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "N", "request").when(F.col("l_returnflag") == "A", "response").otherwise("resource").alias("type"),
        (F.col("l_quantity") > 5).alias("has_payload"), F.col("l_shipdate").alias("date"), F.lit(False).alias("incomplete"),
    )
    return rows.select("warc_id", "record_no", "l_partkey", "l_suppkey", indexable(floor="1996-01-01 00:00:00").alias("indexed"))


@query("select page_id, case page_id % 4 when 0 then 'response' when 1 then 'resource' when 2 then 'metadata' end kind from pages")
def record_kinds(v: Views) -> DataFrame:
    k = F.col("page_id") % 4
    kind = F.when(k == 1, "resource").when(k == 2, "metadata")
    return v.table("pages").select("page_id", record_kind(kind, F.when(k == 3, F.concat(F.lit("dns:"), "url")).otherwise(F.col("url"))).alias("kind"))
