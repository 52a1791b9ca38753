"""Capture dates as column expressions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyyMMddHHmmss"


def to_arc_date(date: Column) -> Column:
    """`2000-09-29T00:48:50.123Z` as `20000929004850`; 14 characters stay as they are; null if neither."""
    iso = F.regexp_extract(date, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.\d+)?Z$", 1)
    return F.when(F.length(date) == 14, date).otherwise(F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")), FORMAT))


def parse_arc_date(date: Column) -> Column:
    return F.try_to_timestamp(date, F.lit(FORMAT))


def repair(date: Column) -> Column:
    """A 14-digit date from a damaged one.

    16 digits lose one `00`, and 18 two, at even places after the year; 12 get `00` at the end.
    The first result that is a date counts; else the date is cut to 14 digits."""
    drop = lambda d: F.filter(
        F.transform(F.sequence(F.lit(5), F.length(d) - 1, F.lit(2)), lambda i: F.when(F.substr(d, i, F.lit(2)) == "00", F.concat(F.substr(d, F.lit(1), i - 1), F.substr(d, i + 2)))),
        lambda x: x.isNotNull(),
    )
    once = F.when(F.length(date) >= 6, drop(date)).otherwise(F.array().cast("array<string>"))
    twice = F.flatten(F.transform(once, drop))
    tried = F.when(F.length(date) == 12, F.array(F.concat(date, F.lit("00")))).when(F.length(date) == 16, once).when(F.length(date) == 18, twice).otherwise(F.array(date))
    good = F.try_element_at(F.filter(tried, lambda x: parse_arc_date(x).isNotNull()), F.lit(1))
    return F.coalesce(good, F.substr(date, F.lit(1), F.lit(14)))


def within_stats(date: Column, now: Column) -> Column:
    """Does a capture date count for the times of a file: after 1990 began and less than 900 days ahead?"""
    return (date > F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")) & (date < now + F.expr("interval 900 days"))


def sync_token(time: Column, key: Column) -> Column:
    """`2024-01-01T00:00:00Z,5`; a fraction of a second is shown only where there is one."""
    fraction = F.regexp_replace(F.date_format(time, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z,"), key.cast("string"))


def parse_sync_token(token: Column) -> Column:
    """struct<time, warc_id> of a token; both null if it is malformed."""
    text = F.regexp_replace(F.substring_index(token, ",", 1), "Z$", "")
    return F.struct(text.try_cast("timestamp_ntz").alias("time"), F.substring_index(token, ",", -1).try_cast("long").alias("warc_id"))
