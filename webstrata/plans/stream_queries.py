"""Streams over the supplied tables, run to the end of the data, with the result as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.plans.fixtures import Views
from webstrata.plans.registry import query
from webstrata.streaming import feeds


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share; locally a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="webstrata-")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def _events(v: Views, to: str) -> DataFrame:
    """History as a stream of files, in order of id."""
    v.warc_history.repartitionByRange(4, "id").write.parquet(to)
    return feeds.table_stream(v.spark, to, v.warc_history.schema, 1)


@query("select warc_id, id, time, warc_state_id from (select *, row_number() over (partition by warc_id order by id desc) rn from warc_history) where rn = 1")
def stream_latest_state(v: Views) -> DataFrame:
    top = _folder(v.spark)
    feeds.run_once(feeds.latest_state(_events(v, f"{top}/in")), feeds.append_once(f"{top}/out"), f"{top}/state", "update")
    return feeds.merged(v.spark, f"{top}/out", ["warc_id"], "id")


@query("select id, warc_id, warc_state_id from warc_history")
def stream_state_feed(v: Views) -> DataFrame:
    """Every history row once, though the source delivers each twice."""
    top = _folder(v.spark)
    rows = v.warc_history
    rows.unionByName(rows).repartition(4).write.parquet(f"{top}/in")
    stream = feeds.state_feed(feeds.table_stream(v.spark, f"{top}/in", rows.schema), "400 days")
    feeds.run_once(stream, feeds.append_once(f"{top}/out"), f"{top}/state")
    return v.spark.read.parquet(f"{top}/out").select("id", "warc_id", "warc_state_id")


@query("select path, max(size) size, cast(max(size) as bigint) total_delta from (select concat('/in/', cast(warc_id as varchar), '.warc.gz.open') path, id + 1 size from warc_history) group by path")
def stream_growing_files(v: Views) -> DataFrame:
    """The largest size of each growing file, and the sum of the growths that were seen."""
    top = _folder(v.spark)
    rows = v.warc_history.select(F.concat(F.lit("/in/"), F.col("warc_id").cast("string"), F.lit(".warc.gz.open")).alias("path"), (F.col("id") + 1).alias("size"))
    rows.repartitionByRange(3, "size").write.parquet(f"{top}/in")
    stream = feeds.grown_files(feeds.table_stream(v.spark, f"{top}/in", rows.schema, 1))
    feeds.run_once(stream, feeds.append_once(f"{top}/out"), f"{top}/state", "update")
    return v.spark.read.parquet(f"{top}/out").groupBy("path").agg(F.max("size").alias("size"), F.sum("delta").alias("total_delta"))


@query("select cast(date_trunc('hour', time) as timestamp) as hour, warc_state_id, count(*) n from warc_history group by all")
def stream_hourly_changes(v: Views) -> DataFrame:
    """Ids aren't in order of time, so the watermark is wider than the whole history."""
    top = _folder(v.spark)
    stream = feeds.hourly_changes(_events(v, f"{top}/in"), "4000 days")
    feeds.run_once(stream, feeds.append_once(f"{top}/out"), f"{top}/state", "update")
    return feeds.merged(v.spark, f"{top}/out", ["window", "warc_state_id"], "n").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "warc_state_id", "n")


@query("""select warc_id, bool_or(id % 3 <> 0 and id * 100 - coalesce(lf, -4611686018427387904) >= 3600) due
    from (select *, max(case when id % 3 = 0 then id * 100 end) over (partition by warc_id) lf from warc_history) group by warc_id""")
def stream_index_queue_retries(v: Views) -> DataFrame:
    top = _folder(v.spark)
    rows = v.warc_history.select("warc_id", (F.col("id") * 100).alias("at"), (F.col("id") % 3 == 0).alias("failed"))
    rows.repartition(2).write.parquet(f"{top}/in")
    feeds.run_once(feeds.retries(feeds.table_stream(v.spark, f"{top}/in", rows.schema)), feeds.append_once(f"{top}/out"), f"{top}/state", "update")
    return v.spark.read.parquet(f"{top}/out").select("warc_id", "due")


@query("select id, name from crawl where state = 2")
def stream_import_queue(v: Views) -> DataFrame:
    top = _folder(v.spark)
    v.crawl.repartition(3).write.parquet(f"{top}/in")
    feeds.import_queue(feeds.table_stream(v.spark, f"{top}/in", v.crawl.schema, 1), lambda b: b.select("id", "name"), f"{top}/out", f"{top}/state")
    return v.spark.read.parquet(f"{top}/out").select("id", "name")


@query("""select concat('/w/', page_id, case when page_id % 4 = 0 then '.warc.gz.open' else '.warc.gz' end) path, case when page_id % 5 = 0 then 0 else page_id + 10 end size, (case when page_id % 5 = 0 then 0 else page_id + 10 end) - (case when page_id % 3 = 0 then 0 else page_id end) delta,
    case when page_id % 5 = 0 then 'ignore' when page_id % 4 <> 0 then 'close' else 'reindex' end as action from pages""")
def watched_folder(v: Views) -> DataFrame:
    k = F.col("page_id")
    size = F.when(k % 5 == 0, 0).otherwise(k + 10).cast("long")
    before = v.table("pages").where(k % 3 != 0).select(F.concat(F.lit("/w/"), k.cast("string"), F.lit(".warc.gz.open")).alias("path"), k.alias("size"))
    now = v.table("pages").select(F.concat(F.lit("/w/"), k.cast("string"), F.when(k % 4 == 0, ".warc.gz.open").otherwise(".warc.gz")).alias("path"), size.alias("size"))
    return feeds.closed_files(before, now)
