"""Joins of the catalogue and of its registry, and existence checks.

Joins are equi-joins that Spark plans by size; results list columns of one side by name,
so equal column names never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.operators.catalogue import after, after_pair, latest


def files_in_series(warcs: DataFrame, crawls: DataFrame, series_id: int, start: int, limit: int) -> DataFrame:
    """The next `limit` files after id `start` of the crawls of a series."""
    own = crawls.where(F.col("crawl_series_id") == series_id).select(F.col("id").alias("crawl_id"))
    return after(warcs.join(own, "crawl_id", "left_semi"), "id", start, limit)


def files_in_collection(warcs: DataFrame, crawls: DataFrame, collection_series: DataFrame, collection_id: int, start: int, limit: int) -> DataFrame:
    """The `limit` files from id `start` on of the series of a collection."""
    series = collection_series.where(F.col("collection_id") == collection_id).select("crawl_series_id").distinct()
    own = crawls.join(series, "crawl_series_id", "left_semi").select(F.col("id").alias("crawl_id"))
    return after(warcs.join(own, "crawl_id", "left_semi"), "id", start, limit, inclusive=True)


def sync_feed(history: DataFrame, warcs: DataFrame, crawls: DataFrame, collection_series: DataFrame, collection_id: int, state_at_least: int = 2, start_time=None, start_id: int = 0, limit: int = 100) -> DataFrame:
    """(time, warc_id, url_count) of the next files of a collection whose latest state is at least
    the given one, in order of (time, warc_id), after a token. The state is that of the latest row."""
    now = latest(history, "warc_id").where(F.col("warc_state_id") >= state_at_least)
    series = collection_series.where(F.col("collection_id") == collection_id).select("crawl_series_id").distinct()
    own = crawls.join(series, "crawl_series_id", "left_semi").select(F.col("id").alias("crawl_id"))
    files = warcs.join(own, "crawl_id", "left_semi").select(F.col("id").alias("warc_id"), F.col("records").alias("url_count"))
    return after_pair(now.select("time", "warc_id").join(files, "warc_id").select("time", "warc_id", "url_count"), "time", "warc_id", start_time, start_id, limit)


def crawls_of_files(warcs: DataFrame, crawls: DataFrame, filenames: list[str]) -> DataFrame:
    """(filename, crawl_id, crawl_name) of the files in a list; files without a crawl stay."""
    own = warcs.where(F.col("filename").isin(filenames)).select("filename", "crawl_id")
    return own.join(crawls.select(F.col("id").alias("crawl_id"), F.col("name").alias("crawl_name")), "crawl_id", "left").select("filename", "crawl_id", "crawl_name")


def crawls_with_series_name(crawls: DataFrame, series: DataFrame) -> DataFrame:
    """Crawls with series_name, null for crawls without series."""
    names = series.select(F.col("id").alias("crawl_series_id"), F.col("name").alias("series_name"))
    return crawls.join(names, "crawl_series_id", "left").select(*crawls.columns, "series_name")


def collections_of_series(collection_series: DataFrame, collections: DataFrame, series_id: int) -> DataFrame:
    return collection_series.where(F.col("crawl_series_id") == series_id).join(collections, collection_series["collection_id"] == collections["id"], "left").select(*(collections[c] for c in collections.columns))


def registry_titles(title_gather: DataFrame, title: DataFrame, status: DataFrame, individual: DataFrame, agency: DataFrame, organisation: DataFrame) -> DataFrame:
    """(gather_url, pi, name, status_name, owner, agency) of the titles with a url; what is missing is null."""
    out = title_gather.where(F.nullif("gather_url", F.lit("")).isNotNull()).join(title, "title_id", "left")
    out = out.join(status.withColumnRenamed("status_id", "current_status_id"), "current_status_id", "left")
    out = out.join(individual.select(F.col("individual_id").alias("current_owner_id"), F.col("userid").alias("owner")), "current_owner_id", "left")
    out = out.join(agency.select("agency_id", "organisation_id"), "agency_id", "left").join(organisation.select("organisation_id", F.col("alias").alias("agency")), "organisation_id", "left")
    return out.select("gather_url", "pi", "name", "status_name", "owner", "agency")


def registry_agencies(agency: DataFrame, organisation: DataFrame) -> DataFrame:
    own = organisation.select("organisation_id", "name", "url", F.col("alias").alias("abbreviation"))
    return agency.join(own, "organisation_id", "left").select(F.col("agency_id").alias("id"), "name", "url", "abbreviation")


def subjects_of_parent(subjects: DataFrame, parent_id: int) -> DataFrame:
    """(id, name, parent_id) of the subjects right below a subject, by name."""
    own = subjects.where(F.col("subject_parent_id") == parent_id).orderBy("subject_name", "subject_id")
    return own.select(F.col("subject_id").alias("id"), F.col("subject_name").alias("name"), F.col("subject_parent_id").alias("parent_id"))


def subjects_of_collection(subjects: DataFrame, members: DataFrame, collection_id: int) -> DataFrame:
    """(id, name, parent_id) of the subjects of a registry collection."""
    return subjects.join(members.where(F.col("col_id") == collection_id).select("subject_id"), "subject_id").select(F.col("subject_id").alias("id"), F.col("subject_name").alias("name"), F.col("subject_parent_id").alias("parent_id"))


def registry_instances(instances: DataFrame, start: int, limit: int, type_name: str | None = None, except_type: str = "Legacy cgi") -> DataFrame:
    """The next instance ids of state 1; of one type, or of all but one. Null types are in neither."""
    kind = F.col("type_name") == type_name if type_name is not None else F.col("type_name") != except_type
    return after(instances.where((F.col("current_state_id") == 1) & kind).select("instance_id"), "instance_id", start, limit)


def instances_with_titles(instances: DataFrame, titles: DataFrame) -> DataFrame:
    """(instance_id, pi, dt, name), the date as yyyyMMdd-HHmm."""
    return instances.join(titles.select("title_id", "pi", "name"), "title_id").select("instance_id", "pi", F.date_format("instance_date", "yyyyMMdd-HHmm").alias("dt"), "name")


def instance_files(files: DataFrame, prefix: str = "arc-") -> DataFrame:
    """(pi, dt, path, filename) of files (path) that lie in the folder of their instance, `%03d/pi/`, and
    are named `<prefix><pi>-<date>-....warc.gz`."""
    name = F.substring_index("path", "/", -1)
    pi, dt = F.regexp_extract(name, rf"^\Q{prefix}\E(\d+)-(\d+-\d+)-.*\.warc\.gz$", 1), F.regexp_extract(name, rf"^\Q{prefix}\E(\d+)-(\d+-\d+)-.*\.warc\.gz$", 2)
    folder = F.concat(F.lpad(F.expr("cast(pi as bigint) div 1000").cast("string"), 3, "0"), F.lit("/"), F.col("pi"), F.lit("/"))
    return files.select("path", name.alias("filename"), pi.alias("pi"), dt.alias("dt")).where("pi <> ''").where(F.substring_index("path", "/", -3).startswith(folder)).select(F.col("pi").cast("long").alias("pi"), "dt", "path", "filename")


def new_instances(instances: DataFrame, crawls: DataFrame, prefix: str = "arc-") -> DataFrame:
    """(instance_id, crawl_name) of the instances (instance_id, pi, dt, name) without a crawl yet."""
    known = crawls.where("instance_id is not null").select("instance_id")
    return instances.join(known, "instance_id", "left_anti").select("instance_id", F.concat("name", F.lit(f" [{prefix}"), F.col("pi").cast("string"), F.lit("-"), "dt", F.lit("]")).alias("crawl_name"))


#: Fixed values: (folder, generation, file prefix, is the date without its time) of the artifacts of an instance.
INSTANCE_ARTIFACTS = (
    ("access", "arc1", "ac-ar1", True), ("preserve", "arc1", "ps-ar1", True), ("mime", "arc1", "mi-ar1", True),
    ("access", "arc2", "ac-ar2", True), ("preserve", "arc2", "ps-ar2", True), ("mime", "arc2", "mi-ar2", True),
    ("access", "arc3", "ac-ar2", False), ("preserve", "arc3", "ps-ar2", False), ("mime", "arc3", "mi-ar2", False),
)


def instance_artifacts(instances: DataFrame, listing: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """(instance_id, kind, path, relpath) of the artifact files of instances (instance_id, pi, dt) that a
    listing (path) has and the catalogue (instance_id, relpath) doesn't."""
    pi, folder = F.col("pi").cast("string"), F.lpad(F.expr("pi div 1000").cast("string"), 3, "0")
    files = [
        F.struct(F.lit(f"{kind}_{gen}").alias("kind"), F.concat(F.lit(f"{root}/{kind}/{gen}/"), folder, F.lit("/"), pi, F.lit(f"/{head}-"), pi, F.lit("-"), F.substring("dt", 1, 8) if short else F.col("dt"), F.lit(".tgz")).alias("path"))
        for kind, gen, head, short in INSTANCE_ARTIFACTS
    ]
    wanted = instances.select("instance_id", F.inline(F.array(*files))).withColumn("relpath", F.substring_index("path", "/", -1))
    return wanted.join(listing.select("path").distinct(), "path", "left_semi").join(known.select("instance_id", "relpath"), ["instance_id", "relpath"], "left_anti").select("instance_id", "kind", "path", "relpath")


def not_yet(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key the catalogue doesn't have."""
    return rows.join(known.select(*key).distinct(), key, "left_anti")


def documents_with_collections(documents: DataFrame, files: DataFrame, collection_series: DataFrame, collections: DataFrame) -> DataFrame:
    """Documents (with warc_id) with the collections of their file's series: array of (id, name) by id, empty if none.

    `files` has warc_id and crawl_series_id. Collections are gathered for each series, of
    which there are few, before they meet the documents."""
    own = collection_series.join(collections.select(F.col("id").alias("collection_id"), "name"), "collection_id").groupBy("crawl_series_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("collection_id").alias("id"), "name"))).alias("collections")
    )
    out = documents.join(files.select("warc_id", "crawl_series_id"), "warc_id", "left").join(own, "crawl_series_id", "left")
    return out.select(*documents.columns, F.coalesce("collections", F.array().cast("array<struct<id:bigint,name:string>>")).alias("collections"))


# seed lists


def _numbered(seeds: DataFrame) -> DataFrame:
    return seeds.withColumn("n", F.row_number().over(Window.partitionBy("surt").orderBy("id")))


def compare_seedlists(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, surt, left_id, right_id) with side common, left or right. Lists are bags: each seed pairs
    with one of the same SURT at most, in order of id."""
    a, b = _numbered(left).select("surt", "n", F.col("id").alias("left_id")), _numbered(right).select("surt", "n", F.col("id").alias("right_id"))
    side = F.when(F.col("left_id").isNull(), "right").when(F.col("right_id").isNull(), "left").otherwise("common")
    return a.join(b, ["surt", "n"], "full_outer").select(side.alias("side"), "surt", "left_id", "right_id")


def _seed_of_key(seeds: DataFrame) -> DataFrame:
    """Seeds (id, surt, key) with one for each key, the last in order of (surt, id)."""
    last = seeds.where("key is not null").groupBy("key").agg(F.max(F.struct("surt", "id")).alias("s"))
    return last.select("key", F.col("s.id").alias("seed_id"), F.col("s.surt").alias("surt"))


def seeds_with_titles(seeds: DataFrame, titles: DataFrame) -> DataFrame:
    """(seed_id, surt, pi, title) of the titles (pi, name, key) whose key a seed has."""
    return titles.where("key is not null").join(_seed_of_key(seeds), "key").select("seed_id", "surt", "pi", F.col("name").alias("title"))


def matches_in_order(seeds: DataFrame, titles: DataFrame) -> DataFrame:
    """The rows of `seeds_with_titles` sorted by SURT, then seed and title."""
    return seeds_with_titles(seeds, titles).orderBy("surt", "seed_id", "pi")


def seeds_without_title(seeds: DataFrame, titles: DataFrame) -> DataFrame:
    return _seed_of_key(seeds).join(titles.where("key is not null").select("key").distinct(), "key", "left_anti").select("seed_id", "surt")
