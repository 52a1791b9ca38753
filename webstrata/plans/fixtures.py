"""The catalogue as views over the supplied star-schema tables, in Spark and in SQL.

`Views` gives each view as a DataFrame; `SQL` gives the same view as a query, from which
`with_views` builds the WITH clause of an equivalent statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.urls import host, host_surt
from webstrata.operators.catalogue import STATE_NAMES

#: Each view's query; a view may use those before it.
SQL = {
    "agency": "select cast(r_regionkey as bigint) id, r_name name, upper(substr(r_name,1,3)) abbreviation from region",
    "crawl_series": "select cast(n_nationkey as bigint) id, n_name name, case when n_nationkey % 5 = 0 then null else concat('/series/', n_name) end path, cast(n_regionkey as bigint) agency_id from nation",
    "crawl": "select c_custkey id, c_name name, cast(c_nationkey as bigint) crawl_series_id, cast(c_custkey % 3 as int) state, case when c_custkey % 4 = 0 then c_custkey + 100000 end instance_id from customer",
    "capture": "select l_orderkey warc_id, l_linenumber record_no, l_shipdate date, cast(l_quantity as bigint) * 1000 + l_linenumber length from lineitem",
    "warc": """select o.o_orderkey id, o.o_custkey crawl_id, cast(o.o_orderkey % 8 - 4 as int) warc_state_id, concat('WEB-', lpad(cast(o.o_orderkey as varchar(20)), 9, '0'), '.warc.gz') filename,
        cast(round(o.o_totalprice * 100) as bigint) size, coalesce(c.records, 0) records, coalesce(c.record_bytes, 0) record_bytes, c.start_time, c.end_time
        from orders o left join (select warc_id, count(*) records, cast(sum(length) as bigint) record_bytes, min(date) start_time, max(date) end_time from capture group by warc_id) c on c.warc_id = o.o_orderkey""",
    "warc_history": "select event_id id, user_id warc_id, ts time, cast(case event_type when 'view' then 2 when 'click' then 1 when 'purchase' then 3 when 'signup' then 0 else -2 end as int) warc_state_id from events",
    "warc_state": "select * from (values (0,'open'),(1,'imported'),(2,'cdx_indexed'),(3,'solr_indexed'),(-1,'import_error'),(-2,'cdx_error'),(-3,'solr_error'),(-4,'deleted')) s(id, name)",
    "collection": "select cast(row_number() over (order by p_brand) as bigint) id, p_brand name from (select distinct p_brand from part) x",
    "collection_series": "select distinct c.id collection_id, cast(p.p_size % 25 as bigint) crawl_series_id from part p join collection c on c.name = p.p_brand",
    "title": "select page_id pi, concat('title ', page_id) name, case when page_id % 7 = 0 then '' else regexp_replace(url, '^https?://', 'http://') end gather_url from pages where page_id % 3 = 0",
    "artifact": """select p_partkey id, p_partkey % (select count(*) from customer) crawl_id, concat(replace(p_name, ' ', '-'), case p_size % 5 when 0 then '.log' when 1 then '.cxml' when 2 then '.recover.gz' when 3 then '.dump' else '-language-buckets.tar.gz' end) relpath,
        cast(round(p_retailprice * 100) as bigint) size from part""",
    "language_bucket": "select doc_id % (select count(*) from customer) crawl_id, lang as language, cast(1 as bigint) pages from documents",
    "seed": "select page_id id, page_id % 2 seedlist_id, url, concat('(', array_to_string(list_reverse(string_split(lower(regexp_extract(url,'://([^/?#:]+)',1)),'.')),','),',') surt from pages",
}


def with_views(sql: str) -> str:
    """`sql` with a WITH clause for the views that it uses, directly or through others."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL:
            if name not in used and re.search(rf"(?:from|join|,)\s+{name}\b", text, re.I):
                used.add(name)
                visit(SQL[name])

    visit(sql)
    parts = [f"{name} as ({SQL[name]})" for name in SQL if name in used]
    return f"with {', '.join(parts)} {sql}" if parts else sql


class Views:
    """The views as DataFrames over the tables in a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def agency(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.upper(F.substring("r_name", 1, 3)).alias("abbreviation"))

    @property
    def crawl_series(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
            F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("/series/"), "n_name")).alias("path"), F.col("n_regionkey").cast("long").alias("agency_id"),
        )

    @property
    def crawl(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("crawl_series_id"),
            (F.col("c_custkey") % 3).cast("int").alias("state"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") + 100000).alias("instance_id"),
        )

    @property
    def capture(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("warc_id"), F.col("l_linenumber").alias("record_no"), F.col("l_shipdate").alias("date"),
            (F.col("l_quantity").cast("long") * 1000 + F.col("l_linenumber")).alias("length"),
        )

    @property
    def warc(self) -> DataFrame:
        stats = self.capture.groupBy("warc_id").agg(F.count("*").alias("records"), F.sum("length").alias("record_bytes"), F.min("date").alias("start_time"), F.max("date").alias("end_time"))
        o = self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("crawl_id"), (F.col("o_orderkey") % 8 - 4).cast("int").alias("warc_state_id"),
            F.concat(F.lit("WEB-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".warc.gz")).alias("filename"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
        )
        return o.join(stats, o["id"] == stats["warc_id"], "left").select(
            "id", "crawl_id", "warc_state_id", "filename", "size", F.coalesce("records", F.lit(0).cast("long")).alias("records"),
            F.coalesce("record_bytes", F.lit(0).cast("long")).alias("record_bytes"), "start_time", "end_time",
        )

    @property
    def warc_history(self) -> DataFrame:
        state = F.create_map(*(F.lit(x) for x in ("view", 2, "click", 1, "purchase", 3, "signup", 0)))
        return self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("warc_id"), F.col("ts").alias("time"), F.coalesce(F.try_element_at(state, "event_type"), F.lit(-2)).alias("warc_state_id"))

    @property
    def warc_state(self) -> DataFrame:
        rows = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(v).alias("name")) for k, v in STATE_NAMES.items()))
        return self.spark.range(1).select(F.inline(rows))

    @property
    def collection(self) -> DataFrame:
        # the distinct brands are a small dimension, so that one sorted array holds them
        brands = self.table("part").agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))
        return brands.select(F.posexplode("brands").alias("n", "name")).select((F.col("n") + 1).cast("long").alias("id"), "name")

    @property
    def collection_series(self) -> DataFrame:
        part = self.table("part").select(F.col("p_brand").alias("name"), (F.col("p_size") % 25).cast("long").alias("crawl_series_id")).distinct()
        return part.join(self.collection, "name").select(F.col("id").alias("collection_id"), "crawl_series_id")

    @property
    def title(self) -> DataFrame:
        return self.table("pages").where("page_id % 3 = 0").select(
            F.col("page_id").alias("pi"), F.concat(F.lit("title "), F.col("page_id").cast("string")).alias("name"),
            F.when(F.col("page_id") % 7 == 0, "").otherwise(F.regexp_replace("url", "^https?://", "http://")).alias("gather_url"),
        )

    @property
    def artifact(self) -> DataFrame:
        n = self.table("customer").agg(F.count("*")).scalar()
        suffix = F.create_map(*(F.lit(x) for x in (0, ".log", 1, ".cxml", 2, ".recover.gz", 3, ".dump", 4, "-language-buckets.tar.gz")))
        return self.table("part").select(
            F.col("p_partkey").alias("id"), (F.col("p_partkey") % n).alias("crawl_id"),
            F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), suffix[F.col("p_size") % 5]).alias("relpath"), F.round(F.col("p_retailprice") * 100).cast("long").alias("size"),
        )

    @property
    def language_bucket(self) -> DataFrame:
        n = self.table("customer").agg(F.count("*")).scalar()
        return self.table("documents").select((F.col("doc_id") % n).alias("crawl_id"), F.col("lang").alias("language"), F.lit(1).cast("long").alias("pages"))

    @property
    def seed(self) -> DataFrame:
        return self.table("pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 2).alias("seedlist_id"), "url", host_surt(host(F.col("url"))).alias("surt"))
