"""Page documents and language statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions import text as T
from webstrata.operators import extract as X
from webstrata.plans.fixtures import Views
from webstrata.plans.registry import query
from webstrata.sources import sinks


def _pages(v: Views) -> DataFrame:
    return v.table("pages").select(F.col("page_id").alias("id"), "url", "html")


@query()
def page_documents(v: Views) -> DataFrame:
    return X.page_documents(_pages(v)).withColumn("links", F.to_json("links")).withColumn("h1", F.to_json("h1"))


_UNESCAPE = "regexp_replace(regexp_replace({}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
_TITLE = _UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")


@query(f"select page_id id, regexp_replace(regexp_replace({_TITLE}, '^\\s+|\\s+$', '', 'g'), '\\s{{2,}}', ' ', 'g') title from pages")
def page_titles(v: Views) -> DataFrame:
    return X.page_documents(_pages(v)).select("id", "title")


@query()
def page_headings(v: Views) -> DataFrame:
    return X.page_documents(_pages(v)).select("id", F.posexplode("h1").alias("n", "heading"))


@query("select page_id id, len(regexp_extract_all(html, '<a href=\"([^\"]+)\"')) n_links, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1), ' ') hrefs from pages")
def page_links(v: Views) -> DataFrame:
    links = F.filter("links", lambda x: x["type"] == "a")
    return X.page_documents(_pages(v)).select("id", F.size(links).cast("long").alias("n_links"), F.array_join(F.transform(links, lambda x: x["href"]), " ").alias("hrefs"))


_HREF = _UNESCAPE.format("unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1))")


@query(f"select page_id id, concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), regexp_replace({_HREF}, '#.*', '')) url from pages")
def page_link_urls(v: Views) -> DataFrame:
    links = X.page_documents(_pages(v)).select("id", F.explode("links").alias("l")).where("l.type = 'a'")
    return links.select("id", F.col("l.url").alias("url"))


@query("select format('{:<12s} {:d}', language, cast(sum(pages) as bigint)) line from language_bucket group by language order by sum(pages) desc, language")
def language_report_lines(v: Views) -> DataFrame:
    sums = v.language_bucket.groupBy("language").agg(F.sum("pages").cast("long").alias("pages"))
    return sums.orderBy(F.desc("pages"), "language").select(sinks.language_line(F.col("language"), F.col("pages")).alias("line"))


@query("select surt from seed where seedlist_id = 0 order by surt, id")
def seed_export(v: Views) -> DataFrame:
    return v.seed.where("seedlist_id = 0").orderBy("surt", "id").select("surt")


@query("select concat('W', cast(l_orderkey as varchar), ' ', cast(l_partkey as varchar)) line from lineitem where l_orderkey % 3 <> 0")
def index_deletion(v: Views) -> DataFrame:
    lines = v.table("lineitem").select("l_orderkey", F.concat(F.lit("W"), F.col("l_orderkey").cast("string"), F.lit(" "), F.col("l_partkey").cast("string")).alias("line"))
    return sinks.remaining(lines.select("line"), lines.where("l_orderkey % 3 = 0").select("line"))


@query("select doc_id, length(text) n, strlen(text) n_bytes, length(text) - length(replace(text, chr(10), '')) + 1 n_lines from documents")
def text_lengths(v: Views) -> DataFrame:
    t = F.col("text")
    return v.table("documents").select("doc_id", F.length(t).cast("long").alias("n"), F.octet_length(t).cast("long").alias("n_bytes"), F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines"))


@query("select doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) digest from documents")
def headings_normalised(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(T.heading_text(F.col("text"))).alias("digest"))
