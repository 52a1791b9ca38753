"""Lookups, pages, keyset pages and joins of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.operators import catalogue as C
from webstrata.operators import joins as J
from webstrata.plans.fixtures import Views
from webstrata.plans.registry import query

SERIES = "collection_series cs join crawl c on c.crawl_series_id = cs.crawl_series_id"


@query("select * from warc")
def file_scan(v: Views) -> DataFrame:
    return v.warc


@query("select * from warc where id = 42")
def file_by_id(v: Views) -> DataFrame:
    return C.matching(v.warc, id=42)


@query("select * from warc order by id limit 1")
def any_file(v: Views) -> DataFrame:
    return C.first(v.warc)


@query("select * from warc where filename = 'WEB-000000077.warc.gz'")
def file_by_name(v: Views) -> DataFrame:
    return C.matching(v.warc, filename="WEB-000000077.warc.gz")


@query("select * from warc where crawl_id = (select crawl_id from warc where id = 77) and filename = 'WEB-000000077.warc.gz'")
def file_by_crawl_and_name(v: Views) -> DataFrame:
    crawl = v.warc.where("id = 77").select("crawl_id")
    return C.matching(v.warc.join(F.broadcast(crawl), "crawl_id", "left_semi"), filename="WEB-000000077.warc.gz").select(*v.warc.columns)


@query("select * from warc where crawl_id = 5")
def files_by_crawl(v: Views) -> DataFrame:
    return C.matching(v.warc, crawl_id=5)


@query("select * from warc where warc_state_id = 1 order by id limit 1024")
def files_in_state(v: Views) -> DataFrame:
    return C.matching(v.warc, warc_state_id=1).orderBy("id").limit(1024)


@query("select w.id, coalesce(s.name, concat('unknown_', cast(w.warc_state_id as varchar))) state_name from warc w left join warc_state s on s.id = w.warc_state_id")
def file_state_names(v: Views) -> DataFrame:
    return v.warc.select("id", C.state_name(F.col("warc_state_id")).alias("state_name"))


@query("select * from crawl where id = 7 union all select * from crawl where instance_id = 100008")
def crawl_lookups(v: Views) -> DataFrame:
    return C.matching(v.crawl, id=7).unionByName(C.matching(v.crawl, instance_id=100008))


@query("select * from crawl where crawl_series_id = 3 order by id desc")
def crawls_in_series(v: Views) -> DataFrame:
    return C.matching(v.crawl, crawl_series_id=3).orderBy(F.desc("id"))


@query("select * from crawl where state = 1")
def crawls_in_state(v: Views) -> DataFrame:
    return C.matching(v.crawl, state=1)


@query("select id, instance_id from crawl where instance_id is not null and id > 100 order by id limit 100")
def registry_crawl_ids(v: Views) -> DataFrame:
    return C.after(v.crawl.where("instance_id is not null").select("id", "instance_id"), "id", 100, 100)


@query("select * from artifact where crawl_id = 3 union all select * from artifact where id = 12")
def artifact_lookups(v: Views) -> DataFrame:
    return C.matching(v.artifact, crawl_id=3).unionByName(C.matching(v.artifact, id=12))


@query("select * from crawl where 'tool-' || cast(id as varchar) = 'tool-9'")
def crawl_by_capture_tool(v: Views) -> DataFrame:
    crawls = v.crawl.withColumn("capture_tool_id", F.concat(F.lit("tool-"), F.col("id").cast("string")))
    return C.matching(crawls, capture_tool_id="tool-9").drop("capture_tool_id")


@query("select a.* from artifact a join artifact k on k.crawl_id = a.crawl_id and k.relpath = a.relpath where k.id = 12")
def artifact_by_crawl_and_path(v: Views) -> DataFrame:
    """All artifacts at the place of one of them."""
    place = C.matching(v.artifact, id=12).select("crawl_id", "relpath")
    return v.artifact.join(place, ["crawl_id", "relpath"], "left_semi").select(*v.artifact.columns)


@query("""select cs.collection_id, w.id warc_id, w.records, w.record_bytes from warc w join crawl c on c.id = w.crawl_id join collection_series cs on cs.crawl_series_id = c.crawl_series_id
    where cs.collection_id = 3 and w.id = (select min(w.id) from warc w join crawl c on c.id = w.crawl_id join collection_series cs on cs.crawl_series_id = c.crawl_series_id where cs.collection_id = 3)""")
def collection_file_by_key(v: Views) -> DataFrame:
    """What one file contributes to one collection, by the key of both."""
    crawls = v.crawl.select(F.col("id").alias("crawl_id"), "crawl_series_id")
    rows = v.warc.join(crawls, "crawl_id").join(v.collection_series, "crawl_series_id").select("collection_id", F.col("id").alias("warc_id"), "records", "record_bytes")
    own = C.matching(rows, collection_id=3)
    return own.where(F.col("warc_id") == own.agg(F.min("warc_id")).scalar())


@query("select * from collection where id = 4")
def collection_by_id(v: Views) -> DataFrame:
    return C.matching(v.collection, id=4)


@query("select * from collection order by name, id")
def collections_by_name(v: Views) -> DataFrame:
    return v.collection.orderBy("name", "id")


@query("select seedlist_id id, count(*) total_seeds from seed group by seedlist_id")
def seedlists(v: Views) -> DataFrame:
    return v.seed.groupBy(F.col("seedlist_id").alias("id")).agg(F.count("*").alias("total_seeds"))


@query("""select w.id, w.crawl_id, w.filename, coalesce(n.s, h.warc_state_id, w.warc_state_id) warc_state_id from warc w left join (select warc_id, arg_max(warc_state_id, id) warc_state_id from warc_history group by warc_id) h on h.warc_id = w.id
    left join (select id, -4 s from warc where id % 6 = 0) n on n.id = w.id""")
def file_states_after_changes(v: Views) -> DataFrame:
    """The states of all files after a batch of changes has been appended to the history."""
    later = v.warc_history.agg(F.max("id")).scalar()
    changes = v.warc.where("id % 6 = 0").select((F.col("id") + later).alias("id"), F.col("id").alias("warc_id"), F.lit(None).cast("timestamp_ntz").alias("time"), F.lit(-4).alias("warc_state_id"))
    history = v.warc_history.withColumn("time", F.col("time").cast("timestamp_ntz")).unionByName(changes)
    return C.with_states(v.warc.select("id", "crawl_id", "filename", "warc_state_id"), history)


@query("select * from artifact where relpath like '%-language-buckets.tar.gz'")
def language_artifacts(v: Views) -> DataFrame:
    return v.artifact.where(F.col("relpath").like("%-language-buckets.tar.gz"))


@query("select * from crawl_series where path is not null order by name, id")
def series_importable(v: Views) -> DataFrame:
    return v.crawl_series.where("path is not null").orderBy("name", "id")


@query("select * from crawl_series order by name, id")
def series_by_name(v: Views) -> DataFrame:
    return v.crawl_series.orderBy("name", "id")


@query("select * from crawl_series where agency_id = 2 and name = 'NATION_7'")
def series_by_agency_and_name(v: Views) -> DataFrame:
    return C.matching(v.crawl_series, agency_id=2, name="NATION_7")


@query("select * from collection order by name, id limit 10 offset 10")
def collections_page(v: Views) -> DataFrame:
    return C.page(v.collection, ["name", "id"], 2, 10)


@query("select * from agency where id = 1")
def agency_by_id(v: Views) -> DataFrame:
    return C.matching(v.agency, id=1)


@query("select * from seed where seedlist_id = 1 order by surt, id")
def seeds_of_list(v: Views) -> DataFrame:
    return C.matching(v.seed, seedlist_id=1).orderBy("surt", "id")


@query("select id, name from (values (1, 'CdxIndexer'), (2, 'Importer'), (3, 'WatchImporter')) t(id, name) order by id")
def tasks(v: Views) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in ((2, "Importer"), (3, "WatchImporter"), (1, "CdxIndexer"))))
    return v.spark.range(1).select(F.inline(rows)).orderBy("id")


@query("select * from crawl_series where agency_id = 2")
def visible_series(v: Views) -> DataFrame:
    return C.visible(v.crawl_series, 2)


@query("select * from crawl_series where true")
def visible_series_of_administrator(v: Views) -> DataFrame:
    return C.visible(v.crawl_series, None, see_all=True)


@query("""select distinct u.r_name as "user", p.permission from (select r_name, case r_regionkey % 5 when 0 then 'infouser' when 1 then 'stduser' when 2 then 'agadmin' when 3 then 'panadmin' else 'nobody' end role from region) u
    join (values ('stduser','SERIES_VIEW_AGENCY'),('agadmin','SERIES_EDIT_AGENCY'),('panadmin','SERIES_EDIT_ALL'),('panadmin','SERIES_VIEW_ALL')) p(role, permission) on p.role = u.role""")
def role_permissions(v: Views) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ("infouser", "stduser", "agadmin", "panadmin", "nobody"))), F.col("r_regionkey") % 5 + 1)
    return C.permissions(v.table("region").select(F.col("r_name").alias("user"), role.alias("role")))


@query("""select concat('https://catalogue.example/data/warcs/', cast(w.id as varchar)) url, concat('https://catalogue.example/data/text/', cast(w.id as varchar)) text_url, filename, size, sha256(filename) sha256, records, record_bytes, start_time, end_time
    from warc w join crawl c on c.id = w.crawl_id where c.crawl_series_id in (1, 2, 3) order by filename, w.id limit 10000""")
def data_api_page(v: Views) -> DataFrame:
    return C.data_api_page(v.warc.withColumn("sha256", F.sha2("filename", 256)), v.crawl.where(F.col("crawl_series_id").isin(1, 2, 3)), "https://catalogue.example")


@query("select w.* from warc w join crawl c on c.id = w.crawl_id where c.crawl_series_id = 3 and w.id > 50 order by w.id limit 200")
def files_in_series_keyset(v: Views) -> DataFrame:
    return J.files_in_series(v.warc, v.crawl, 3, 50, 200).select(*v.warc.columns)


@query("select * from warc where id > 1000 order by id limit 500")
def files_keyset(v: Views) -> DataFrame:
    return C.after(v.warc, "id", 1000, 500)


@query("select * from warc where warc_state_id = 2 order by id limit 100 offset 100")
def files_in_state_page(v: Views) -> DataFrame:
    return C.page(C.matching(v.warc, warc_state_id=2), ["id"], 2)


@query("select * from warc where crawl_id = 8 order by filename, id limit 100 offset 0")
def files_in_crawl_page(v: Views) -> DataFrame:
    return C.page(C.matching(v.warc, crawl_id=8), ["filename", "id"])


@query("select * from warc where crawl_id = 8 and warc_state_id = -2 order by id limit 100")
def files_in_crawl_state_page(v: Views) -> DataFrame:
    return C.page(C.matching(v.warc, crawl_id=8, warc_state_id=-2), ["id"])


@query(f"select id, records as url_count from warc where crawl_id in (select c.id from {SERIES} where cs.collection_id = 1) and id >= 10 order by id limit 1000")
def collection_files_json(v: Views) -> DataFrame:
    return J.files_in_collection(v.warc, v.crawl, v.collection_series, 1, 10, 1000).select("id", F.col("records").alias("url_count"))


_FEED = f"""select h.time, h.warc_id, w.records as url_count from (select *, row_number() over (partition by warc_id order by id desc) rn from warc_history) h join warc w on w.id = h.warc_id
    where rn = 1 and h.warc_state_id >= 2 and w.crawl_id in (select c.id from {SERIES} where cs.collection_id = 1)"""


@query(_FEED + " order by h.time, h.warc_id limit 100")
def sync_feed(v: Views) -> DataFrame:
    return J.sync_feed(v.warc_history, v.warc, v.crawl, v.collection_series, 1)


@query(_FEED + " and (h.time > timestamp '2024-01-29 12:00:00' or h.time = timestamp '2024-01-29 12:00:00' and h.warc_id > 10) order by h.time, h.warc_id limit 100")
def sync_feed_after_token(v: Views) -> DataFrame:
    return J.sync_feed(v.warc_history, v.warc, v.crawl, v.collection_series, 1, start_time="2024-01-29 12:00:00", start_id=10)


@query("select id, warc_id, time, warc_state_id from (select *, row_number() over (partition by warc_id order by id desc) rn from warc_history) where rn = 1")
def latest_state_per_file(v: Views) -> DataFrame:
    return C.latest(v.warc_history, "warc_id")


@query("select id, warc_id, time, warc_state_id from (select *, lead(warc_state_id) over (partition by warc_id order by id) following from warc_history) where warc_state_id <> 2 or following is null or following <> 2")
def history_collapsed(v: Views) -> DataFrame:
    return C.collapse_states(v.warc_history)


@query("select w.filename, w.crawl_id, c.name crawl_name from warc w left join crawl c on c.id = w.crawl_id where w.filename in ('WEB-000000001.warc.gz', 'WEB-000000500.warc.gz', 'none')")
def crawls_by_filename(v: Views) -> DataFrame:
    return J.crawls_of_files(v.warc, v.crawl, ["WEB-000000001.warc.gz", "WEB-000000500.warc.gz", "none"])


_TIMES = "select crawl_id, max(end_time) end_time from warc group by crawl_id"


@query(f"select c.*, t.end_time, s.name series_name from crawl c left join crawl_series s on s.id = c.crawl_series_id left join ({_TIMES}) t on t.crawl_id = c.id order by t.end_time desc nulls last, c.id desc limit 100")
def crawls_with_series_name_page(v: Views) -> DataFrame:
    times = v.warc.groupBy("crawl_id").agg(F.max("end_time").alias("end_time")).withColumnRenamed("crawl_id", "id")
    dated = v.crawl.join(times, "id", "left")
    return C.page(J.crawls_with_series_name(dated, v.crawl_series), [F.desc_nulls_last("end_time"), F.desc("id")])


@query("select * from crawl where crawl_series_id = 4 order by id desc limit 100")
def crawls_in_series_page(v: Views) -> DataFrame:
    own = v.crawl.join(v.crawl_series.where("id = 4").select(F.col("id").alias("crawl_series_id")), "crawl_series_id", "left_semi")
    return C.page(own.select(*v.crawl.columns), [F.desc("id")])


@query("select c.* from collection_series cs left join collection c on c.id = cs.collection_id where cs.crawl_series_id = 6")
def collections_for_series(v: Views) -> DataFrame:
    return J.collections_of_series(v.collection_series, v.collection, 6)


@query("select count(*) total, cast(100 as bigint) page_size, cast(2 as bigint) current_page, cast(100 as bigint) as \"offset\", greatest(cast((count(*) + 99) // 100 as bigint), 1) last_page from warc where warc_state_id = 1")
def pager_metadata(v: Views) -> DataFrame:
    return C.pager(C.matching(v.warc, warc_state_id=1), 2)


# the registry, made of orders, customers and suppliers


@query("""select concat('http://', lower(p.p_brand), '.example/') gather_url, p.p_partkey pi, p.p_name name, case p.p_size % 4 when 0 then 'selected' when 1 then 'monitored' when 2 then 'ceased' end status_name,
    s.s_name as owner, n.n_name agency from part p left join supplier s on s.s_suppkey = p.p_size left join nation n on n.n_nationkey = p.p_size % 30 where p.p_partkey % 9 <> 0""")
def registry_titles(v: Views) -> DataFrame:
    p = v.table("part")
    title = p.select(F.col("p_partkey").alias("title_id"), F.col("p_partkey").alias("pi"), F.col("p_name").alias("name"), (F.col("p_size") % 4).alias("current_status_id"), F.col("p_size").cast("long").alias("current_owner_id"), (F.col("p_size") % 30).alias("agency_id"))
    gather = p.select(F.col("p_partkey").alias("title_id"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("http://"), F.lower("p_brand"), F.lit(".example/"))).alias("gather_url"))
    status = v.spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(i).alias("status_id"), F.lit(n).alias("status_name")) for i, n in enumerate(("selected", "monitored", "ceased"))))))
    individual = v.table("supplier").select(F.col("s_suppkey").alias("individual_id"), F.col("s_name").alias("userid"))
    agency = v.table("nation").select(F.col("n_nationkey").alias("agency_id"), F.col("n_nationkey").alias("organisation_id"))
    organisation = v.table("nation").select(F.col("n_nationkey").alias("organisation_id"), F.col("n_name").alias("alias"))
    return J.registry_titles(gather, title, status, individual, agency, organisation)


@query("select n.n_nationkey id, r.r_name name, concat('http://', lower(replace(r.r_name, ' ', '-')), '.example/') url, substr(r.r_name, 1, 3) abbreviation from nation n left join region r on r.r_regionkey = n.n_regionkey")
def registry_agencies(v: Views) -> DataFrame:
    agency = v.table("nation").select(F.col("n_nationkey").alias("agency_id"), F.col("n_regionkey").alias("organisation_id"))
    organisation = v.table("region").select(
        F.col("r_regionkey").alias("organisation_id"), F.col("r_name").alias("name"), F.concat(F.lit("http://"), F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))), F.lit(".example/")).alias("url"), F.substring("r_name", 1, 3).alias("alias")
    )
    return J.registry_agencies(agency, organisation)


@query("select cast(n_nationkey as bigint) id, n_name name, n_regionkey parent_id from nation where n_regionkey = 2 order by name, id")
def registry_subjects_of_parent(v: Views) -> DataFrame:
    subjects = v.table("nation").select(F.col("n_nationkey").cast("long").alias("subject_id"), F.col("n_name").alias("subject_name"), F.col("n_regionkey").alias("subject_parent_id"))
    return J.subjects_of_parent(subjects, 2)


@query("select distinct cast(n_nationkey as bigint) id, n_name name, n_regionkey parent_id from nation where n_nationkey in (select p_size % 25 from part where p_brand = 'Brand#1')")
def registry_subjects_of_collection(v: Views) -> DataFrame:
    subjects = v.table("nation").select(F.col("n_nationkey").cast("long").alias("subject_id"), F.col("n_name").alias("subject_name"), F.col("n_regionkey").alias("subject_parent_id"))
    members = v.table("part").where("p_brand = 'Brand#1'").select(F.lit(1).alias("col_id"), (F.col("p_size") % 25).cast("long").alias("subject_id")).distinct()
    return J.subjects_of_collection(subjects, members, 1)


_INSTANCE = "select o_orderkey instance_id, o_custkey title_id, case o_orderstatus when 'F' then 1 else 2 end current_state_id, o_orderdate instance_date, case when o_orderkey % 10 = 0 then null when o_orderkey % 10 < 3 then 'Legacy cgi' else o_orderpriority end type_name from orders"


def _instances(v: Views) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderkey") % 10 < 3, "Legacy cgi").otherwise(F.col("o_orderpriority"))
    return v.table("orders").select(
        F.col("o_orderkey").alias("instance_id"), F.col("o_custkey").alias("title_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("current_state_id"), F.col("o_orderdate").alias("instance_date"), kind.alias("type_name")
    )


@query(f"select instance_id from ({_INSTANCE}) where current_state_id = 1 and instance_id > 20 and type_name <> 'Legacy cgi' order by instance_id limit 100")
def registry_instances_page(v: Views) -> DataFrame:
    return J.registry_instances(_instances(v), 20, 100)


@query(f"select instance_id from ({_INSTANCE}) where current_state_id = 1 and instance_id > 20 and type_name = 'Legacy cgi' order by instance_id limit 100")
def registry_instances_of_type_page(v: Views) -> DataFrame:
    return J.registry_instances(_instances(v), 20, 100, type_name="Legacy cgi")


_DATED = f"select i.instance_id, c.c_custkey pi, strftime(i.instance_date, '%Y%m%d-%H%M') dt, c.c_name name from ({_INSTANCE}) i join customer c on c.c_custkey = i.title_id"


def _dated(v: Views) -> DataFrame:
    return J.instances_with_titles(_instances(v), v.table("customer").select(F.col("c_custkey").alias("title_id"), F.col("c_custkey").alias("pi"), F.col("c_name").alias("name")))


@query(_DATED)
def registry_instances_with_titles(v: Views) -> DataFrame:
    return _dated(v)


@query(f"select instance_id, concat(name, ' [arc-', cast(pi as varchar), '-', dt, ']') crawl_name from ({_DATED}) where instance_id not in (select instance_id - 100000 from crawl where instance_id is not null)")
def registry_import_new(v: Views) -> DataFrame:
    return J.new_instances(_dated(v), v.crawl.select((F.col("instance_id") - 100000).alias("instance_id")))


@query(f"""select instance_id, 'access_arc3' kind, concat('/master/access/arc3/', lpad(cast(pi // 1000 as varchar), 3, '0'), '/', cast(pi as varchar), '/ac-ar2-', cast(pi as varchar), '-', dt, '.tgz') path, concat('ac-ar2-', cast(pi as varchar), '-', dt, '.tgz') relpath
    from ({_DATED}) d where instance_id % 2 = 0 and (pi, dt) in (select (pi, dt) from ({_DATED}) where instance_id % 3 = 0)""")
def registry_artifacts_new(v: Views) -> DataFrame:
    dated = _dated(v)
    pi = F.col("pi").cast("string")
    name = F.concat(F.lit("ac-ar2-"), pi, F.lit("-"), "dt", F.lit(".tgz"))
    listing = dated.where("instance_id % 3 = 0").select(F.concat(F.lit("/master/access/arc3/"), F.lpad(F.expr("pi div 1000").cast("string"), 3, "0"), F.lit("/"), pi, F.lit("/"), name).alias("path"))
    known = dated.where("instance_id % 2 = 1").select("instance_id", name.alias("relpath"))
    return J.instance_artifacts(dated, listing, known, "/master")


@query(f"""select pi, dt, concat('/in/', lpad(cast(pi // 1000 as varchar), 3, '0'), '/', cast(pi as varchar), '/arc-', cast(pi as varchar), '-', dt, '-001.warc.gz') path, concat('arc-', cast(pi as varchar), '-', dt, '-001.warc.gz') filename from ({_DATED}) where instance_id % 2 = 0""")
def registry_instance_files(v: Views) -> DataFrame:
    pi = F.col("pi").cast("string")
    # every other file lies in the wrong folder
    folder = F.when(F.col("instance_id") % 2 == 0, F.lpad(F.expr("pi div 1000").cast("string"), 3, "0")).otherwise("xxx")
    files = _dated(v).select(F.concat(F.lit("/in/"), folder, F.lit("/"), pi, F.lit("/arc-"), pi, F.lit("-"), "dt", F.lit("-001.warc.gz")).alias("path"))
    return J.instance_files(files)


@query("select relpath, crawl_id from artifact where relpath not in (select relpath from artifact where id % 2 = 0)")
def artifacts_not_yet_known(v: Views) -> DataFrame:
    return J.not_yet(v.artifact.select("relpath", "crawl_id"), v.artifact.where("id % 2 = 0"), ["relpath"]).select("relpath", "crawl_id")
