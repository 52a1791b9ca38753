"""Text documents from archive records: text, title, metadata, links and headings of HTML pages.

A record that isn't a web response, resource or metadata is left out; one whose body
can't be extracted becomes a document with text_error. Links resolve against the record's
own url; a page's base element is not heeded. PDF and office formats have no extractor
here: they get a text_error that says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions import binary as B
from webstrata.functions import dates as D
from webstrata.functions import text as T
from webstrata.functions import urls as U
from webstrata.operators.capture_index import record_kind

TEXT_LIMIT = 1_048_576
"""Most characters of a document's text, as the format has it."""

#: Elements whose content is no text of the page.
_SILENT = frozenset(("script", "style", "noscript", "template"))
#: Elements after and before which text is apart.
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Fixed values: (element, attribute) pairs that are links.
_LINKS = {"a": "href", "link": "href", "img": "src", "iframe": "src", "script": "src", "area": "href", "frame": "src"}


class Page(HTMLParser):
    """Collects what a document has of an HTML page."""

    def __init__(self, html: str, url: str | None):
        super().__init__(convert_charrefs=True)
        self.url, self.texts, self.titles, self.headings = url, [], [], []
        self.meta: dict[str, str] = {}
        self.links: list[dict] = []
        self._silent = self._title = self._h1 = 0
        self._open: list[tuple[dict, list[str]]] = []
        self.feed(html)
        self.close()
        self._end_link()
        self.text = "".join(self.texts)
        self.title = "".join(self.titles) if self.titles else None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = {k: v or "" for k, v in reversed(attrs)}
        if tag in _SILENT:
            self._silent += 1
        if tag in _BLOCK:
            self.texts.append("\n")
        if tag == "title" and not self.titles:
            self._title += 1
        if tag == "h1":
            self._h1 += 1
            if self._h1 == 1:
                self.headings.append([])
        elif self._h1 and tag in _BLOCK:
            self.headings[-1].append(" ")
        if tag == "meta" and (name := found.get("name") or found.get("property")) and "content" in found:
            self.meta.setdefault(name, found["content"])
        if tag in _LINKS:
            self._link(tag, found)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _link(self, tag: str, found: dict[str, str]) -> None:
        href = found.get(_LINKS[tag], "")
        if tag == "a":
            self._end_link()
        if href == "" or href[:5].lower() == "data:":
            return
        link = {"type": tag, "href": href, "text": None, "rel": found.get("rel") or None, "title": found.get("title") or None, "url": None}
        try:
            link["url"] = urljoin(self.url, href) if self.url else None
        except ValueError:
            pass
        self.links.append(link)
        if tag == "a":
            self._open.append((link, []))
        elif tag == "img":
            link["text"] = found.get("alt") or None

    def _end_link(self) -> None:
        while self._open:
            link, words = self._open.pop()
            link["text"] = "".join(words) or None

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self._silent = max(0, self._silent - 1)
        if tag in _BLOCK:
            self.texts.append("\n")
        if tag == "title":
            self._title = 0
        if tag == "h1":
            self._h1 = max(0, self._h1 - 1)
        if tag == "a":
            self._end_link()

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        if self._title:
            self.titles.append(data)
            return
        self.texts.append(data)
        if self._h1:
            self.headings[-1].append(data)
        for _, words in self._open:
            words.append(data)


_LINK = "array<struct<type:string,href:string,text:string,rel:string,title:string,url:string>>"
_LINK_ARROW = pa.list_(pa.struct([(k, pa.string()) for k in ("type", "href", "text", "rel", "title", "url")]))


def html_parts(pages: DataFrame, *carried: str) -> DataFrame:
    """Per row of pages (id, url, html): id, the carried columns, raw_text, raw_title, meta, h1, links, failed. Null html gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if html is None:
                    rows.append((None, None, None, None, None, False))
                    continue
                try:
                    p = Page(html, url)
                    rows.append((p.text, p.title, list(p.meta.items()), ["".join(h) for h in p.headings], p.links, False))
                except (AssertionError, ValueError, RecursionError):  # what the parser raises on broken markup
                    rows.append((None, None, None, None, None, True))
            types = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), _LINK_ARROW, pa.bool_()]
            kept = [batch.column(k + 3) for k in range(len(carried))]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, *made], ["id", *carried, "raw_text", "raw_title", "meta", "h1", "links", "failed"])

    rows = pages.select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), *carried)
    own = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in carried)
    return rows.mapInArrow(run, f"id long, {own}raw_text string, raw_title string, meta map<string,string>, h1 array<string>, links {_LINK}, failed boolean")


def page_documents(pages: DataFrame, *carried: str, limit: int | None = TEXT_LIMIT) -> DataFrame:
    """Per row of pages (id, url, html): id, the carried columns, title, text (of at most `limit` characters;
    None for whole texts), the meta properties, h1 and links, cleaned."""
    clean = F.transform("links", lambda x: x.withField("url", U.clean_url(x["url"])))
    capped = lambda c: c if limit is None else F.substring(c, 1, limit)
    return html_parts(pages, *carried).select(
        "id", *carried, T.collapse_space(F.col("raw_title")).alias("title"), capped(T.collapse_space(capped(F.col("raw_text")))).alias("text"),
        F.when(F.col("failed"), "can't be parsed").alias("text_error"), *(T.property_of(F.col("meta"), name).alias(name) for name in T.META_NAMES),
        F.filter(F.transform("h1", T.heading_text), lambda h: h != "").alias("h1"), clean.alias("links"),
    )


def documents(records: DataFrame, archive_prefix: str = "http://archive.example/pan/", limit: int | None = TEXT_LIMIT) -> DataFrame:
    """Documents of the records of archives (see `webstrata.sources.archive`): one for each record, read
    and parsed in one pass, without a join."""
    kind = record_kind(F.col("type"), F.col("url"))
    head = T.headers(F.col("http_header"))
    mime = T.content_type(F.when(F.col("http_header").isNotNull(), F.try_element_at(head, F.lit("content-type"))).otherwise(F.col("content_type")))
    r = records.where(F.col("url").isNotNull() & kind.isNotNull() & ~((kind == "response") & F.col("http_header").isNull() & F.col("content_type").contains("application/http")))
    r = r.select(
        "path", "filename", "position", "number", kind.alias("kind"), F.col("url").alias("delivery_url"), U.clean_url(U.original_url(F.col("url"), archive_prefix)).alias("url"),
        F.when(F.col("date").rlike(r"^\d+$"), D.repair(F.col("date"))).otherwise(D.to_arc_date(F.col("date"))).alias("date"), mime.alias("content_type"),
        F.when(kind == "response", T.status_code(F.substring_index("http_header", "\n", 1))).alias("status_code"), F.length("payload").cast("long").alias("content_length"),
        F.coalesce(B.digest_of_header(F.col("digest")), B.sha1_base32(F.col("payload"))).alias("content_sha1"), F.try_element_at(head, F.lit("location")).alias("location"), "payload",
        T.is_brotli(F.try_element_at(head, F.lit("content-encoding"))).alias("brotli"),
    )
    html = F.when((F.col("content_type") == "text/html") & ~F.col("brotli"), F.make_valid_utf8(F.col("payload").cast("string")))
    carried = [c for c in r.columns if c not in ("payload", "number")]
    parts = page_documents(r.select(F.col("number").alias("id"), "url", html.alias("html"), F.struct(*carried).alias("record")), "record", limit=limit)
    error = F.when(F.col("brotli"), "content-encoding br is not supported").when(F.col("content_type") == "text/html", F.col("text_error")).otherwise(
        F.coalesce(T.text_error(F.col("content_type")), F.lit("no extractor for content-type"))
    )
    target = U.resolve(F.col("url"), F.col("location"))
    redirect = F.array(F.struct(F.lit("location").alias("type"), F.col("location").alias("href"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("rel"), F.lit(None).cast("string").alias("title"), target.alias("url")))
    links = F.coalesce("links", F.array().cast(_LINK))
    out = parts.select("*", "record.*").drop("record")
    return out.select(
        "path", "filename", F.col("position").alias("warc_offset"), "url", "delivery_url", "date", "status_code", "content_length", "content_type", "title", "text", error.alias("text_error"), "content_sha1",
        U.site(F.col("url")).alias("site"), U.host(F.col("url")).alias("host"), *T.META_NAMES, F.when(F.col("location").isNotNull(), F.concat(links, redirect)).otherwise(links).alias("links"), "h1",
    )
