"""Capture index lines and file statistics from archive records.

Input rows are those of `webstrata.sources.archive`. A capture line has eleven fields,
`urlkey date url mimetype status digest redirect - length position filename`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import binary as B
from webstrata.functions import dates as D
from webstrata.functions import text as T
from webstrata.functions import urls as U

#: Captures before this are garbage.
DATE_FLOOR = "1990-01-01 00:00:00"


def indexable(floor: str = DATE_FLOOR, date: str = "date") -> Column:
    """Is a record (type, has_payload, date, incomplete) indexed? Unknown dates aren't; unknown completeness doesn't count."""
    whole = ~F.coalesce(F.col("incomplete"), F.lit(False))
    return F.coalesce(F.col("type").isin("response", "resource") & F.col("has_payload") & (F.col(date) >= F.lit(floor).cast("timestamp_ntz")) & whole, F.lit(False))


def record_kind(type: Column, url: Column) -> Column:
    """response, resource or metadata for text extraction; null for other records. A record without type
    (of an ARC file) is a response unless its url is not of the web."""
    web = ~(url.startswith("dns:") | url.startswith("filedesc:") | url.startswith("whois:"))
    return F.when((type.isNull() | (type == "response")) & web, "response").when(type == "resource", "resource").when(type == "metadata", "metadata")


def captures(records: DataFrame) -> DataFrame:
    """The indexed captures: path, filename, position, length, urlkey, date, url, mime, status, digest, redirect, captured."""
    r = records
    head = T.headers(F.col("http_header"))
    arc = F.when(F.col("date").rlike(r"^\d+$"), D.repair(F.col("date"))).otherwise(D.to_arc_date(F.col("date")))
    kind = record_kind(F.col("type"), F.col("url"))
    body_only = F.col("http_header").rlike(r"^HTTP/[^\r\n]*$") & (F.length("payload") == 0)
    r = r.where(F.col("url").isNotNull() & kind.isin("response", "resource")).select(
        "path", "filename", "position", "length", "url", arc.alias("date"), kind.alias("type"), "request_method", "request_body",
        F.col("payload").isNotNull().alias("has_payload"),
        (body_only & F.map_contains_key("headers", "warc-json-metadata") & F.map_contains_key("headers", "warc-page-id")).alias("incomplete"),
        F.when(kind == "response", T.status_code(F.substring_index("http_header", "\n", 1))).otherwise(200).alias("status"),
        F.coalesce(T.content_type(F.when(F.col("http_header").isNotNull(), F.try_element_at(head, F.lit("content-type"))).otherwise(F.col("content_type"))), F.lit("application/octet-stream")).alias("mime"),
        F.coalesce(B.digest_of_header(F.col("digest")), B.sha1_base32(F.col("payload"))).alias("digest"), F.try_element_at(head, F.lit("location")).alias("location"),
    )
    r = r.withColumn("captured", D.parse_arc_date(F.col("date")).cast("timestamp_ntz"))
    r = r.where(indexable(date="captured"))
    key = F.when(F.col("request_method").isNotNull(), U.request_key(F.col("url"), F.col("request_method"), F.col("request_body"))).otherwise(U.surt(F.col("url")))
    redirect = F.when(F.col("status").between(300, 399) & F.col("location").isNotNull(), U.resolve(F.col("url"), F.col("location")))
    return r.select("path", "filename", "position", "length", key.alias("urlkey"), "date", "url", "mime", "status", "digest", redirect.alias("redirect"), "captured")


def lines(captures: DataFrame) -> DataFrame:
    """(path, filename, line) of captures."""
    fields = ["urlkey", "date", "url", T.index_escape(F.col("mime")), F.col("status").cast("string"), "digest", F.coalesce(T.index_escape(F.col("redirect")), F.lit("-")), F.lit("-"), F.col("length").cast("string"), F.col("position").cast("string"), "filename"]
    return captures.select("path", "filename", F.concat_ws(" ", *(F.coalesce(F.col(f) if isinstance(f, str) else f, F.lit("-")) for f in fields)).alias("line"))


def alias_lines(aliases: DataFrame) -> DataFrame:
    """(line) of aliases (alias, target): `@alias <alias> <target>`."""
    return aliases.select(F.concat(F.lit("@alias "), "alias", F.lit(" "), "target").alias("line"))


def statistics(records: DataFrame, found: DataFrame) -> DataFrame:
    """(path, filename, records, record_bytes, start_time, end_time, software) of files, from their records and captures."""
    own = found.groupBy("path").agg(F.count("*").alias("records"), F.sum("length").alias("record_bytes"), F.min("captured").alias("start_time"), F.max("captured").alias("end_time"))
    files = records.groupBy("path", "filename").agg(F.max_by("software", F.when(F.col("software").isNotNull(), F.col("number"))).alias("software"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.join(own, "path", "left").select("path", "filename", zero("records"), zero("record_bytes"), "start_time", "end_time", "software")
