"""Statistics of files, crawls, series and collections, computed from facts.

Counters are never kept by adding to them: each is an aggregate of the files that are not
deleted. Where a stored snapshot is to be brought up to date, `apply_deltas` adds the
aggregated differences of a batch, and gives what a full recompute gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions.dates import within_stats
from webstrata.operators.catalogue import DELETED

COUNTERS = ("warc_files", "warc_size", "records", "record_bytes")


def totals(files: DataFrame) -> DataFrame:
    """One row: total_files, total_size, total_records of the files that aren't deleted."""
    return files.where(F.col("warc_state_id") != DELETED).agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"), F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("total_records")
    )


def artifact_totals(artifacts: DataFrame) -> DataFrame:
    return artifacts.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"), F.lit(0).cast("long").alias("total_records"))


def grand_total(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    both = totals(files).unionByName(artifact_totals(artifacts))
    return both.agg(*(F.sum(c).cast("long").alias(c) for c in ("total_files", "total_size", "total_records")))


def _counters(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTERS))


def _file_counters(files: DataFrame) -> DataFrame:
    return files.where(F.col("warc_state_id") != DELETED).select("crawl_id", F.lit(1).cast("long").alias("warc_files"), F.col("size").alias("warc_size"), "records", "record_bytes")


def _filled(out: DataFrame) -> DataFrame:
    return out.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS))


def crawl_rollup(crawls: DataFrame, files: DataFrame) -> DataFrame:
    """(id, warc_files, warc_size, records, record_bytes) of every crawl, by one aggregate and one join."""
    return _filled(crawls.select("id").join(_counters(_file_counters(files), "crawl_id").withColumnRenamed("crawl_id", "id"), "id", "left"))


def series_rollup(series: DataFrame, crawls: DataFrame, files: DataFrame) -> DataFrame:
    per_crawl = crawl_rollup(crawls, files).join(crawls.select("id", "crawl_series_id"), "id")
    return _filled(series.select("id").join(_counters(per_crawl, "crawl_series_id").withColumnRenamed("crawl_series_id", "id"), "id", "left"))


def collection_rollup(collections: DataFrame, collection_series: DataFrame, series_counters: DataFrame) -> DataFrame:
    """(id, records, record_bytes) of every collection, from its series."""
    own = collection_series.distinct().join(series_counters.withColumnRenamed("id", "crawl_series_id"), "crawl_series_id")
    sums = own.groupBy("collection_id").agg(F.sum("records").alias("records"), F.sum("record_bytes").alias("record_bytes"))
    out = collections.select("id").join(sums.withColumnRenamed("collection_id", "id"), "id", "left")
    return out.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("records", "record_bytes")))


def record_stats(captures: DataFrame, now: str) -> DataFrame:
    """(warc_id, records, record_bytes, start_time, end_time) of captures (warc_id, length, date); dates
    outside of 1990 to 900 days after `now` don't count for the times."""
    ok = F.when(within_stats(F.col("date"), F.lit(now).cast("timestamp_ntz")), F.col("date"))
    return captures.groupBy("warc_id").agg(F.count("*").alias("records"), F.sum("length").cast("long").alias("record_bytes"), F.min(ok).alias("start_time"), F.max(ok).alias("end_time"))


def last_software(records: DataFrame) -> DataFrame:
    """(warc_id, software): the software that the last record of a file that names one names."""
    return records.where("software is not null").groupBy("warc_id").agg(F.max_by("software", "position").alias("software"))


def record_lengths(records: DataFrame, file_sizes: DataFrame) -> DataFrame:
    """(warc_id, position, length): from a record's place to that of the next, the last to the end of the file."""
    following = F.lead("position").over(Window.partitionBy("warc_id").orderBy("position"))
    return records.withColumn("following", following).join(file_sizes, "warc_id", "left").select("warc_id", "position", (F.coalesce("following", "size") - F.col("position")).alias("length"))


def crawl_summary(crawls: DataFrame, files: DataFrame, artifacts: DataFrame, languages: DataFrame) -> DataFrame:
    """(id, to_index, corrupt, artifacts, artifact_bytes, languages) of every crawl; bytes are null without artifacts."""
    f = files.groupBy("crawl_id").agg(F.count_if(F.col("warc_state_id") == 1).alias("to_index"), F.count_if(F.col("warc_state_id") == -2).alias("corrupt"))
    a = artifacts.groupBy("crawl_id").agg(F.count("*").alias("artifacts"), F.sum("size").cast("long").alias("artifact_bytes"))
    g = languages.groupBy("crawl_id").agg(F.count_distinct("language").alias("languages"))
    out = crawls.select("id")
    for part in (f, a, g):
        out = out.join(part.withColumnRenamed("crawl_id", "id"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("id", zero("to_index"), zero("corrupt"), zero("artifacts"), "artifact_bytes", zero("languages"))


def counts_by_crawl_and_state(files: DataFrame) -> DataFrame:
    return files.groupBy("crawl_id", "warc_state_id").agg(F.count("*").alias("n"))


def language_stats(buckets: DataFrame) -> DataFrame:
    """(crawl_id, language, pages), summed over all of a crawl's language files."""
    return buckets.groupBy("crawl_id", "language").agg(F.sum("pages").cast("long").alias("pages"))


def series_with_crawl_count(series: DataFrame, crawls: DataFrame) -> DataFrame:
    n = crawls.groupBy("crawl_series_id").agg(F.count("*").alias("crawl_count"))
    out = series.join(n, series["id"] == n["crawl_series_id"], "left")
    return out.select(*(series[c] for c in series.columns), F.coalesce("crawl_count", F.lit(0)).cast("long").alias("crawl_count"))


def crawl_times(crawls: DataFrame, files: DataFrame) -> DataFrame:
    """(id, start_time, end_time): least and greatest times of a crawl's files; missing times don't count."""
    own = files.groupBy("crawl_id").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    return crawls.select("id").join(own.withColumnRenamed("crawl_id", "id"), "id", "left")


def widened(times: DataFrame, new: DataFrame) -> DataFrame:
    """Crawl times (id, start_time, end_time) widened by those of a batch; a missing time keeps the other."""
    n = new.select("id", F.col("start_time").alias("s"), F.col("end_time").alias("e"))
    return times.join(n, "id", "full_outer").select("id", F.least("start_time", "s").alias("start_time"), F.greatest("end_time", "e").alias("end_time"))


# incremental maintenance


def file_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(crawl_id, counters): what the change of a batch of files, from `before` to `after`, adds to each crawl.

    New files are only in `after`, removed ones only in `before`; a file in a deleted state
    counts nothing, so a deletion takes away exactly what the file had counted."""
    minus = _file_counters(before).select("crawl_id", *((-F.col(c)).alias(c) for c in COUNTERS))
    return _counters(_file_counters(after).unionByName(minus), "crawl_id")


def apply_deltas(snapshot: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters (id, ...) with the deltas (id, ...) of a batch added; ids may be in either only."""
    return _counters(snapshot.select("id", *COUNTERS).unionByName(deltas.select("id", *COUNTERS)), "id")


def collection_contributions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(collection_id, records, record_bytes): differences between the contributions (collection_id, warc_id,
    records, record_bytes) that were counted and those that hold now."""
    a = old.select("collection_id", (-F.col("records")).alias("records"), (-F.col("record_bytes")).alias("record_bytes"))
    return a.unionByName(new.select("collection_id", "records", "record_bytes")).groupBy("collection_id").agg(F.sum("records").cast("long").alias("records"), F.sum("record_bytes").cast("long").alias("record_bytes"))


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows inserted, or put in place of those with their key; of rows with one key, the greatest."""
    new = rows.groupBy(*key).agg(F.max(F.struct(*[c for c in rows.columns if c not in key])).alias("r")).select(*key, "r.*")
    return table.join(new.select(*key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def updated(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table with the other columns of `changes` set, also to null, in the rows with their keys; keys that
    the table doesn't have are left out. Of changes with one key, the greatest."""
    fields = [c for c in changes.columns if c not in key]
    new = changes.groupBy(*key).agg(F.max(F.struct(*fields)).alias("_new"))
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
    return table.join(new, key, "left").select(*(value(c) if c in fields else c for c in table.columns))


def replaced(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with all rows of the keys that `rows` has replaced by these."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))
