"""Structured Streaming forms of the polling loops: indexing queue, growing files, state feed.

Streams end with the data that is there (availableNow) or run on a trigger; each writes
through foreachBatch with the batch id as idempotency key, or to a table by file sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH_FILES = 1024
BACK_OFF_SECONDS = 3600


def table_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = BATCH_FILES) -> DataFrame:
    """New Parquet files of a folder, at most so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def archive_stream(spark: SparkSession, path: str, glob: str = "*.warc.gz") -> DataFrame:
    """New archive files of a folder, whole: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", BATCH_FILES).load(path)


def latest_state(history: DataFrame) -> DataFrame:
    """(warc_id, id, time, warc_state_id) of each file's newest row, for update mode. State: one row a file."""
    newest = F.max(F.struct("id", "time", "warc_state_id"))
    return history.groupBy("warc_id").agg(newest.alias("s")).select("warc_id", "s.id", "s.time", "s.warc_state_id")


def state_feed(history: DataFrame, delay: str = "1 hour") -> DataFrame:
    """History rows as they come, each once; a row `delay` older than the newest may be dropped as late."""
    return history.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay).dropDuplicatesWithinWatermark(["id"])


def hourly_changes(history: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(window, warc_state_id, n): state changes an hour, an extension over the polled feed."""
    rows = history.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay)
    return rows.groupBy(F.window("time", "1 hour"), "warc_state_id").agg(F.count("*").alias("n"))


def grown_files(listings: DataFrame) -> DataFrame:
    """(path, size, delta) of the files of a stream of listings (path, size) that are larger than ever before.

    A known path is not a new file to Spark's file stream, so growth is followed by state:
    the largest size of each path."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (before,) = state.get if state.exists else (0,)
        size = max((int(f["size"].max()) for f in frames), default=before)
        if size > before:
            state.update((size,))
            yield pd.DataFrame({"path": [key[0]], "size": [size], "delta": [size - before]})

    return listings.groupBy("path").applyInPandasWithState(run, "path string, size long, delta long", "size long", "update", "NoTimeout")


def retries(candidates: DataFrame, back_off: int = BACK_OFF_SECONDS) -> DataFrame:
    """(warc_id, due) of a stream of candidates (warc_id, at, failed): a file is due unless it failed less than
    back_off seconds before. State: the time of the last failure of each file."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (-(1 << 62),)
        rows = pd.concat(list(frames)).sort_values(["at", "failed"])
        due = False
        for at, failed in zip(rows["at"], rows["failed"]):
            if failed:
                last, due = int(at), False
            elif at - last >= back_off:
                due = True
        state.update((last,))
        yield pd.DataFrame({"warc_id": [key[0]], "due": [due]})

    return candidates.groupBy("warc_id").applyInPandasWithState(run, "warc_id long, due boolean", "last long", "update", "NoTimeout")


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand what is there to `write` in batches, remember how far that came, and stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer whose batches replace themselves when they are repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def merged(spark: SparkSession, path: str, keys: list[str], newest: str) -> DataFrame:
    """The table that a stream in update mode has written with `append_once`: of each key the row with the
    greatest `newest`. A batch writes the keys that it changed, not the whole table."""
    rows = spark.read.parquet(path).drop("batch")
    fields = [c for c in rows.columns if c not in keys and c != newest]
    top = rows.groupBy(*keys).agg(F.max(F.struct(newest, *fields)).alias("_top"))
    return top.select(*(c if c in keys else F.col("_top")[c].alias(c) for c in rows.columns))


def index_queue(spark: SparkSession, source: str, checkpoint: str, target: str, index: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Index the archives of a folder that have not been indexed yet; `index` makes rows of files (path, content)."""
    return run_once(archive_stream(spark, source), lambda batch, n: append_once(target)(index(batch), n), checkpoint)


def import_queue(crawls: DataFrame, do: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Crawls of a stream in state importing (2), with what `do` makes of them, appended to a table."""
    return run_once(crawls.where("state = 2"), lambda batch, n: append_once(target)(do(batch), n), checkpoint)


def closed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, size, delta, action) from two listings of a watched folder: a file whose name lost `.open` is closed, an
    empty one ignored, a larger open one indexed anew. delta is what the file's size adds to the statistics."""
    base = F.regexp_replace("path", r"\.open$", "")
    a = before.select(base.alias("base"), F.col("size").alias("old"), F.col("path").endswith(".open").alias("was_open"))
    b = now.select("path", base.alias("base"), "size", F.col("path").endswith(".open").alias("is_open"))
    out = b.join(a, "base", "left")
    closed = F.coalesce("was_open", F.lit(True)) & ~F.col("is_open")
    grown = F.col("is_open") & (F.col("size") > F.coalesce("old", F.lit(0)))
    action = F.when(F.col("size") == 0, "ignore").when(closed, "close").when(grown, "reindex").otherwise("keep")
    return out.select("path", "size", (F.col("size") - F.coalesce("old", F.lit(0))).alias("delta"), action.alias("action"))
