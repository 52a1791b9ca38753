"""Catalogue queries: lookups, pages, keyset pages, latest rows and visibility.

Every page has a total order, so the same page always has the same rows; keyset pages
filter on the key, which reaches the scan, and take the top rows without a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of an archive file.
STATE_NAMES = {0: "open", 1: "imported", 2: "cdx_indexed", 3: "solr_indexed", -1: "import_error", -2: "cdx_error", -3: "solr_error", -4: "deleted"}
DELETED = -4

PAGE_SIZE = 100


def matching(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values (all of them; None matches nothing, as in SQL)."""
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def first(df: DataFrame, key: str = "id") -> DataFrame:
    """Any one row, made definite: that with the smallest key."""
    return df.orderBy(key).limit(1)


def page(df: DataFrame, order: list, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Page `number` (from 1) in the given order, which must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pager(df: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One row about the pages of df: total, page_size, current_page, offset, last_page.

    The last page is the one with the last row; an empty table has one, empty, page."""
    return df.agg(F.count("*").alias("total")).select(
        "total", F.lit(size).cast("long").alias("page_size"), F.lit(number).cast("long").alias("current_page"),
        F.lit((number - 1) * size).cast("long").alias("offset"), F.greatest(F.expr(f"(total + {size} - 1) div {size}"), F.lit(1)).cast("long").alias("last_page"),
    )


def after(df: DataFrame, key: str, start, limit: int, inclusive: bool = False) -> DataFrame:
    """The next `limit` rows by key after `start`."""
    return df.where(F.col(key) >= start if inclusive else F.col(key) > start).orderBy(key).limit(limit)


def after_pair(df: DataFrame, time: str, key: str, start_time, start_key: int, limit: int) -> DataFrame:
    """The next `limit` rows in order of (time, key) after a pair. start_time None: from the start."""
    if start_time is not None:
        t = F.lit(start_time).cast(df.schema[time].dataType)
        df = df.where((F.col(time) > t) | (F.col(time) == t) & (F.col(key) > start_key))
    return df.orderBy(time, key).limit(limit)


def latest(df: DataFrame, key: str, order: str = "id") -> DataFrame:
    """Of each key the row with the largest `order`."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def state_name(state: Column) -> Column:
    """The name of a state; `unknown_<id>` for others."""
    names = F.create_map(*(F.lit(x) for pair in STATE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, state), F.concat(F.lit("unknown_"), state.cast("string")))


INDEXED = 2


def collapse_states(history: DataFrame, state: int = INDEXED) -> DataFrame:
    """History in which a file that gets `state` again, without another state in between, by id, has only the
    last of these rows, with its newest time. Repeats of other states, such as errors, are events of their own."""
    following = F.lead("warc_state_id").over(Window.partitionBy("warc_id").orderBy("id"))
    again = F.coalesce((F.col("warc_state_id") == state) & (F.col("_next") == state), F.lit(False))
    return history.withColumn("_next", following).where(~again).drop("_next")


def with_states(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files with the state of their latest history row; files without history keep theirs.

    A state change is a row appended to the history, and this gives the files after it."""
    now = latest(history, "warc_id").select(F.col("warc_id").alias("id"), F.col("warc_state_id").alias("_state"))
    state = F.coalesce("_state", "warc_state_id").alias("warc_state_id")
    return files.join(now, "id", "left").select(*(state if c == "warc_state_id" else c for c in files.columns))


def visible(series: DataFrame, agency_id: int | None, see_all: bool = False) -> DataFrame:
    """Series that a user may see: all, or those of their own agency; series without agency are never their own."""
    return series if see_all else series.where(F.col("agency_id") == F.lit(agency_id))


#: What each role may do.
ROLE_PERMISSIONS = {
    "infouser": (),
    "stduser": ("SERIES_VIEW_AGENCY",),
    "agadmin": ("SERIES_EDIT_AGENCY",),
    "panadmin": ("SERIES_EDIT_ALL", "SERIES_VIEW_ALL"),
    "sysadmin": ("SERIES_EDIT_ALL", "SERIES_VIEW_ALL"),
}


def permissions(users: DataFrame, roles: dict = ROLE_PERMISSIONS) -> DataFrame:
    """(user, permission) from (user, role): each permission of each role once; unknown roles have none."""
    table = F.create_map(*(x for role, names in roles.items() for x in (F.lit(role), F.array(*map(F.lit, names)).cast("array<string>"))))
    return users.select("user", F.explode(F.try_element_at(table, "role")).alias("permission")).distinct()


def data_api_page(warcs: DataFrame, allowed_crawls: DataFrame, base_url: str, number: int = 1, size: int = 10_000) -> DataFrame:
    """A page of export rows, by file name, of the files whose crawl is allowed."""
    rows = page(warcs.join(allowed_crawls.select(F.col("id").alias("crawl_id")), "crawl_id", "left_semi"), ["filename", "id"], number, size)
    return rows.select(
        F.concat(F.lit(f"{base_url}/data/warcs/"), F.col("id").cast("string")).alias("url"), F.concat(F.lit(f"{base_url}/data/text/"), F.col("id").cast("string")).alias("text_url"),
        "filename", "size", "sha256", "records", "record_bytes", "start_time", "end_time",
    )
