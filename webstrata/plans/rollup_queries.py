"""Statistics: full recompute, incremental maintenance and their equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.binary import sha256_hex
from webstrata.operators import joins as J
from webstrata.operators import rollup as R
from webstrata.operators import verify as V
from webstrata.plans.fixtures import Views
from webstrata.plans.registry import query

_TOTALS = "select count(*) total_files, coalesce(cast(sum(size) as bigint), 0) total_size, coalesce(cast(sum(records) as bigint), 0) total_records from warc where warc_state_id <> -4"
_ARTIFACTS = "select count(*) total_files, coalesce(cast(sum(size) as bigint), 0) total_size, cast(0 as bigint) total_records from artifact"
_FILES = "select crawl_id, 1 warc_files, size warc_size, records, record_bytes from warc where warc_state_id <> -4"
_SUMS = ", ".join(f"coalesce(cast(sum({{0}}.{c}) as bigint), 0) {c}" for c in R.COUNTERS)
_CRAWL = f"select c.id, {_SUMS.format('f')} from crawl c left join ({_FILES}) f on f.crawl_id = c.id group by c.id"
_SERIES = f"select s.id, {_SUMS.format('r')} from crawl_series s left join crawl c on c.crawl_series_id = s.id left join ({_CRAWL}) r on r.id = c.id group by s.id"


@query(_TOTALS)
def archive_totals(v: Views) -> DataFrame:
    return R.totals(v.warc)


@query(_ARTIFACTS)
def artifact_totals(v: Views) -> DataFrame:
    return R.artifact_totals(v.artifact)


@query(f"select cast(sum(total_files) as bigint) total_files, cast(sum(total_size) as bigint) total_size, cast(sum(total_records) as bigint) total_records from ({_TOTALS} union all {_ARTIFACTS})")
def archive_grand_total(v: Views) -> DataFrame:
    return R.grand_total(v.warc, v.artifact)


@query(_CRAWL)
def crawl_rollup(v: Views) -> DataFrame:
    return R.crawl_rollup(v.crawl, v.warc)


@query(_SERIES)
def series_rollup(v: Views) -> DataFrame:
    return R.series_rollup(v.crawl_series, v.crawl, v.warc)


@query(f"""select k.id, coalesce(cast(sum(r.records) as bigint), 0) records, coalesce(cast(sum(r.record_bytes) as bigint), 0) record_bytes from collection k
    left join collection_series cs on cs.collection_id = k.id left join ({_SERIES}) r on r.id = cs.crawl_series_id group by k.id""")
def collection_rollup(v: Views) -> DataFrame:
    return R.collection_rollup(v.collection, v.collection_series, R.series_rollup(v.crawl_series, v.crawl, v.warc))


@query(_CRAWL)
def incremental_rollup_equals_recompute(v: Views) -> DataFrame:
    """A snapshot of two thirds of the files, some of them smaller than now, brought up to date by deltas."""
    old = v.warc.where("id % 3 <> 0").withColumn("size", F.expr("size div 2")).withColumn("records", F.lit(0).cast("long"))
    deltas = R.file_deltas(old, v.warc).withColumnRenamed("crawl_id", "id")
    return R.apply_deltas(R.crawl_rollup(v.crawl, old), deltas.join(v.crawl.select("id"), "id", "left_semi"))


@query(f"""select crawl_id, cast(-count(*) as bigint) warc_files, cast(-sum(size) as bigint) warc_size, cast(-sum(records) as bigint) records, cast(-sum(record_bytes) as bigint) record_bytes from warc where warc_state_id <> -4 and id % 7 = 0 group by crawl_id""")
def deletion_deltas(v: Views) -> DataFrame:
    """What deleting every seventh file takes from the crawls: once what the files had counted."""
    before = v.warc.where("id % 7 = 0")
    return R.file_deltas(before, before.withColumn("warc_state_id", F.lit(-4))).where("warc_files <> 0")


@query("""select cs.collection_id, cast(sum(w.records) as bigint) records, cast(sum(w.record_bytes) as bigint) record_bytes from warc w join crawl c on c.id = w.crawl_id join collection_series cs on cs.crawl_series_id = c.crawl_series_id where w.id % 4 = 0 group by cs.collection_id""")
def collection_contribution_deltas(v: Views) -> DataFrame:
    files = v.warc.join(v.crawl.select(F.col("id").alias("crawl_id"), "crawl_series_id"), "crawl_id").join(v.collection_series, "crawl_series_id")
    new = files.select("collection_id", F.col("id").alias("warc_id"), "records", "record_bytes")
    return R.collection_contributions(new.where("warc_id % 4 <> 0"), new)


@query("select warc_id, count(*) records, cast(sum(length) as bigint) record_bytes, min(date) filter (date > timestamp '1990-01-01' and date < timestamp '2001-06-19') start_time, max(date) filter (date > timestamp '1990-01-01' and date < timestamp '2001-06-19') end_time from capture group by warc_id")
def file_record_stats(v: Views) -> DataFrame:
    return R.record_stats(v.capture, "1999-01-01 00:00:00")


@query("select warc_id, software from (select l_orderkey warc_id, l_returnflag software, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey desc) rn from lineitem where l_returnflag <> 'N') where rn = 1")
def file_software(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.col("l_orderkey").alias("warc_id"), F.nullif("l_returnflag", F.lit("N")).alias("software"), F.struct("l_extendedprice", "l_partkey").alias("position"))
    return R.last_software(rows)


_POSITIONS = "select l_orderkey warc_id, cast(sum(l_quantity) as bigint) * 1000 + l_partkey as position from lineitem group by l_orderkey, l_partkey"


@query(f"select warc_id, position, coalesce(lead(position) over (partition by warc_id order by position), warc_id + 100000000) - position as length from ({_POSITIONS})")
def record_lengths_from_positions(v: Views) -> DataFrame:
    rows = v.table("lineitem").groupBy(F.col("l_orderkey").alias("warc_id"), "l_partkey").agg(F.sum("l_quantity").cast("long").alias("q")).select("warc_id", (F.col("q") * 1000 + F.col("l_partkey")).alias("position"))
    sizes = v.table("orders").select(F.col("o_orderkey").alias("warc_id"), (F.col("o_orderkey") + 100000000).alias("size"))
    return R.record_lengths(rows, sizes)


@query("""select c.id, coalesce(f.to_index, 0) to_index, coalesce(f.corrupt, 0) corrupt, coalesce(a.n, 0) artifacts, a.b artifact_bytes, coalesce(g.n, 0) languages from crawl c
    left join (select crawl_id, count(*) filter (warc_state_id = 1) to_index, count(*) filter (warc_state_id = -2) corrupt from warc group by 1) f on f.crawl_id = c.id
    left join (select crawl_id, count(*) n, cast(sum(size) as bigint) b from artifact group by 1) a on a.crawl_id = c.id
    left join (select crawl_id, count(distinct language) n from language_bucket group by 1) g on g.crawl_id = c.id""")
def crawl_summary(v: Views) -> DataFrame:
    return R.crawl_summary(v.crawl, v.warc, v.artifact, v.language_bucket)


@query("select crawl_id, warc_state_id, count(*) n from warc group by all")
def file_counts_by_crawl_state(v: Views) -> DataFrame:
    return R.counts_by_crawl_and_state(v.warc)


@query("select (select count(*) from crawl) crawls, (select count(*) from crawl_series) series, (select count(*) from crawl_series where agency_id = 1) series_of_agency, (select count(*) from collection) collections, (select count(*) from artifact) artifacts, (select count(*) from warc where warc_state_id = 1) files_to_index")
def table_counts(v: Views) -> DataFrame:
    tables = {
        "crawls": v.crawl, "series": v.crawl_series, "series_of_agency": v.crawl_series.where("agency_id = 1"), "collections": v.collection,
        "artifacts": v.artifact, "files_to_index": v.warc.where("warc_state_id = 1"),
    }
    return v.spark.range(1).select(*(df.agg(F.count("*")).scalar().alias(name) for name, df in tables.items()))


@query("select cast(sum(size) as bigint) total_bytes from warc where crawl_id = 17")
def batch_bytes(v: Views) -> DataFrame:
    return v.warc.where("crawl_id = 17").agg(F.sum("size").cast("long").alias("total_bytes"))


@query("select cast(sum(size) as bigint) artifact_bytes from artifact where crawl_id = 3")
def artifact_bytes(v: Views) -> DataFrame:
    return v.artifact.where("crawl_id = 3").agg(F.sum("size").cast("long").alias("artifact_bytes"))


@query("select crawl_id, language, cast(sum(pages) as bigint) pages from language_bucket group by all")
def crawl_language_stats(v: Views) -> DataFrame:
    return R.language_stats(v.language_bucket)


@query("select language, cast(sum(pages) as bigint) pages from language_bucket where crawl_id = 3 group by all order by pages desc, language")
def language_rows_of_crawl(v: Views) -> DataFrame:
    return v.language_bucket.where("crawl_id = 3").groupBy("language").agg(F.sum("pages").cast("long").alias("pages")).orderBy(F.desc("pages"), "language")


@query("select s.*, coalesce(c.n, 0) crawl_count from crawl_series s left join (select crawl_series_id, count(*) n from crawl group by 1) c on c.crawl_series_id = s.id order by s.name, s.id limit 100")
def series_with_crawl_count(v: Views) -> DataFrame:
    return R.series_with_crawl_count(v.crawl_series, v.crawl).orderBy("name", "id").limit(100)


@query("select s.*, (select count(*) from crawl c where c.crawl_series_id = s.id) crawl_count from crawl_series s where s.agency_id = 1 order by s.name, s.id limit 100")
def series_for_agency(v: Views) -> DataFrame:
    return R.series_with_crawl_count(v.crawl_series.where("agency_id = 1"), v.crawl).orderBy("name", "id").limit(100)


@query("select c.id, min(w.start_time) start_time, max(w.end_time) end_time from crawl c left join warc w on w.crawl_id = c.id group by c.id")
def crawl_time_range(v: Views) -> DataFrame:
    return R.crawl_times(v.crawl, v.warc)


@query("select c.id, min(w.start_time) start_time, max(w.end_time) end_time from crawl c left join warc w on w.crawl_id = c.id group by c.id")
def crawl_time_range_widened(v: Views) -> DataFrame:
    """The times of one half of the files widened by those of the other half."""
    return R.widened(R.crawl_times(v.crawl, v.warc.where("id % 2 = 0")), R.crawl_times(v.crawl, v.warc.where("id % 2 = 1")))


@query("select id, case when id % 5 = 0 then upper(name) else name end name, abbreviation from agency union all select 99, 'NEW', 'N'")
def agencies_upserted(v: Views) -> DataFrame:
    new = v.agency.where("id % 5 = 0").select("id", F.upper("name").alias("name"), "abbreviation")
    extra = v.spark.range(1).select(F.lit(99).cast("long").alias("id"), F.lit("NEW").alias("name"), F.lit("N").alias("abbreviation"))
    return R.upserted(v.agency, new.unionByName(extra), ["id"])


@query("select id, case when id % 4 = 1 then upper(name) || '!' else name end name, crawl_series_id, case when id % 4 = 1 then null else state end state, instance_id from crawl")
def crawls_updated(v: Views) -> DataFrame:
    """Two fields of some crawls set, one of them to null; a change of an unknown crawl does nothing."""
    known = v.crawl.where("id % 4 = 1").select("id", F.concat(F.upper("name"), F.lit("!")).alias("name"), F.lit(None).cast("int").alias("state"))
    return R.updated(v.crawl, known.unionByName(known.select((-F.col("id") - 1).alias("id"), "name", "state")), ["id"])


@query("select collection_id, crawl_series_id from collection_series where crawl_series_id % 5 <> 1 union all select id, s from (select distinct crawl_series_id s from collection_series where crawl_series_id % 5 = 1), collection where id in (1, 2)")
def series_collections_replaced(v: Views) -> DataFrame:
    """The collections of some series replaced by two others."""
    series = v.collection_series.where("crawl_series_id % 5 = 1").select("crawl_series_id").distinct()
    rows = series.select(F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("collection_id"), "crawl_series_id")
    return R.replaced(v.collection_series, rows, ["crawl_series_id"])


@query("select crawl_id, language, cast(sum(pages) as bigint) pages from language_bucket where crawl_id >= 10 group by all union all select id, 'xx', 5 from crawl where id < 10 and id % 2 = 0 union all select crawl_id, language, cast(sum(pages) as bigint) from language_bucket where crawl_id < 10 and crawl_id % 2 = 1 group by all")
def language_rows_replaced(v: Views) -> DataFrame:
    rows = v.crawl.where("id < 10 and id % 2 = 0").select(F.col("id").alias("crawl_id"), F.lit("xx").alias("language"), F.lit(5).cast("long").alias("pages"))
    return R.replaced(R.language_stats(v.language_bucket), rows, ["crawl_id"])


@query("""select w.id, coalesce(string_agg(k.name, ',' order by k.id), '') collections from warc w left join crawl c on c.id = w.crawl_id left join collection_series cs on cs.crawl_series_id = c.crawl_series_id left join collection k on k.id = cs.collection_id group by w.id""")
def documents_with_collections(v: Views) -> DataFrame:
    files = v.warc.join(v.crawl.select(F.col("id").alias("crawl_id"), "crawl_series_id"), "crawl_id").select(F.col("id").alias("warc_id"), "crawl_series_id")
    out = J.documents_with_collections(v.warc.select(F.col("id").alias("warc_id")), files, v.collection_series, v.collection)
    return out.select(F.col("warc_id").alias("id"), F.array_join("collections.name", ",").alias("collections"))


# verification


@query("""select page_id id, case when page_id % 4 = 0 then 'ERROR' when page_id % 4 = 1 then 'NEW' when page_id % 4 = 2 then 'OK' else 'MISMATCH' end result,
    case when page_id % 4 = 0 then 'gone' when page_id % 4 = 3 then 'other' else sha256(html) end sha256 from pages""")
def scrub_classification(v: Views) -> DataFrame:
    k, real = F.col("page_id") % 4, sha256_hex(F.col("html").cast("binary"))
    manifest = v.table("pages").select(F.col("page_id").alias("id"), F.when(k == 0, "gone").when(k == 2, real).when(k == 3, "other").alias("sha256"))
    return V.scrubbed(manifest, v.table("pages").where(k != 0).select(F.col("page_id").alias("id"), real.alias("digest")))


@query("""select id, case id % 6 when 0 then false when 1 then warc_state_id <> 0 and id % 5 <> 0 when 2 then false when 3 then id % 5 = 0 when 4 then false else true end valid from warc""")
def cache_validity(v: Views) -> DataFrame:
    k = F.col("id") % 6
    digest = F.when(F.col("id") % 5 != 0, F.sha2(F.col("filename"), 256))
    files = v.warc.select("id", "warc_state_id", "size", digest.alias("sha256"))
    cache = v.warc.where(k != 0).select(
        "id", (k != 1).alias("has_meta"), F.when(k == 2, F.col("id") + 1).otherwise(F.col("id")).alias("meta_id"),
        F.when(k == 4, F.col("size") + 1).otherwise(F.col("size")).alias("meta_size"), F.when(k == 3, F.lit("different")).otherwise(digest).alias("meta_sha256"),
    )
    return V.cache_validity(files, cache)


_LOCK = "select c_custkey % 50 k, concat('lock-', cast(c_custkey as varchar)) name, concat('owner-', cast(c_nationkey as varchar)) as owner, 1000000 - c_custkey % 200 checkin_time from customer"


@query(f"select name, owner, checkin_time from ({_LOCK}) where checkin_time + 120 >= 1000000")
def lock_expiry(v: Views) -> DataFrame:
    return V.live_locks(_locks(v), 1_000_000)


def _locks(v: Views) -> DataFrame:
    c = v.table("customer")
    return c.select(F.concat(F.lit("lock-"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("owner-"), F.col("c_nationkey").cast("string")).alias("owner"), (F.lit(1_000_000) - F.col("c_custkey") % 200).alias("checkin_time"))


@query(f"select name, min(owner) as owner, cast(1000000 as bigint) checkin_time, cast(1000000 as bigint) acquire_time from ({_LOCK}) where checkin_time + 120 < 1000000 group by name")
def locks_acquired(v: Views) -> DataFrame:
    return V.acquired(_locks(v), _locks(v).select("name", "owner"), 1_000_000)


@query(f"select name, owner, case when owner = 'owner-3' and checkin_time + 120 >= 1000000 then 1000000 else checkin_time end checkin_time from ({_LOCK}) where owner <> 'owner-4'")
def locks_after_heartbeat(v: Views) -> DataFrame:
    """One owner has checked in, and another has let its locks go."""
    return V.renewed(V.released(_locks(v), "owner-4"), "owner-3", 1_000_000)


@query("select cast(l_orderkey as varchar) filename, min(l_partkey) as position from lineitem where l_returnflag = 'R' group by l_orderkey")
def first_unreadable_record(v: Views) -> DataFrame:
    return V.first_unreadable(v.table("lineitem").select(F.col("l_orderkey").cast("string").alias("filename"), F.col("l_partkey").alias("position"), (F.col("l_returnflag") != "R").alias("parsed")))


@query("select id, case id % 3 when 0 then 'refuse_readable' when 1 then 'replace' else 'refuse_different' end decision from warc")
def blob_replacement(v: Views) -> DataFrame:
    k = F.col("id") % 3
    return V.replaceable(v.warc.select("id", (k == 0).alias("readable"), "size", F.col("filename").alias("sha256"), F.when(k == 2, F.col("size") + 1).otherwise(F.col("size")).alias("new_size"), F.col("filename").alias("new_sha256")))


@query("select id, case when id % 10 = 0 then 'create' else 'patch' end as action, case when id % 10 = 0 then 'name,state' when id % 10 = 1 and state is distinct from 9 then 'name,state' when id % 10 = 1 then 'name' else 'state' end fields from crawl where id % 10 in (0, 1, 2)")
def capture_tool_sync(v: Views) -> DataFrame:
    k = F.col("id") % 10
    source = v.crawl.select("id", F.when(k == 1, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), F.when(k.isin(1, 2), 9).otherwise(F.col("state")).alias("state"))
    return V.changed_fields(source, v.crawl.where(k != 0), "id", ["name", "state"]).select("id", "action", F.array_join("fields", ",").alias("fields"))


@query("select id, lpad(cast(warc_files // 1000 as varchar), 3, '0') folder from (" + _SERIES + ")")
def destination_folders(v: Views) -> DataFrame:
    return R.series_rollup(v.crawl_series, v.crawl, v.warc).select("id", F.lpad(F.expr("warc_files div 1000").cast("string"), 3, "0").alias("folder"))
