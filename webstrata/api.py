"""Entry points over a stored catalogue: what each page, feed, export and command shows, as DataFrames."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.dates import sync_token
from webstrata.operators import capture_index as I
from webstrata.operators import catalogue as C
from webstrata.operators import extract as X
from webstrata.operators import joins as J
from webstrata.operators import rollup as R
from webstrata.operators import verify as V
from webstrata.plans.schema import TABLES
from webstrata.sources import archive, sinks, tables


class Catalogue:
    """The Parquet tables of a folder, `<folder>/<table>.parquet`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise AttributeError(table)
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.folder}/{table}.parquet")

    def home(self) -> DataFrame:
        return R.grand_total(self.warc, self.artifact)

    def health(self) -> DataFrame:
        return C.first(self.warc)

    def collections_page(self, page: int = 1) -> DataFrame:
        return C.page(self.collection, ["name", "id"], page)

    def collection_files(self, collection_id: int, start: int = 0, rows: int = 1000) -> DataFrame:
        return J.files_in_collection(self.warc, self.crawl, self.collection_series, collection_id, start, rows).select("id", F.col("records").alias("url_count"))

    def collection_sync(self, collection_id: int, token: tuple | None = None, limit: int = 100) -> DataFrame:
        """(id, url_count, resumption_token) after a token (time, id), or from the start."""
        time, after = token or (None, 0)
        rows = J.sync_feed(self.warc_history, self.warc, self.crawl, self.collection_series, collection_id, start_time=time, start_id=after, limit=limit)
        return rows.select(F.col("warc_id").alias("id"), "url_count", sync_token(F.col("time"), F.col("warc_id")).alias("resumption_token"))

    def series_page(self, agency_id: int | None = None, see_all: bool = False, page: int = 1) -> DataFrame:
        return C.page(R.series_with_crawl_count(C.visible(self.crawl_series, agency_id, see_all), self.crawl), ["name", "id"], page)

    def series_crawls(self, series_id: int, page: int = 1) -> DataFrame:
        return C.page(C.matching(self.crawl, crawl_series_id=series_id), [F.desc_nulls_last("end_time"), F.desc("id")], page)

    def series_collections(self, series_id: int) -> DataFrame:
        return J.collections_of_series(self.collection_series.select("collection_id", "crawl_series_id"), self.collection, series_id)

    def crawls_page(self, page: int = 1) -> DataFrame:
        return C.page(J.crawls_with_series_name(self.crawl, self.crawl_series), [F.desc_nulls_last("end_time"), F.desc("id")], page)

    def crawl_summary(self, crawl_id: int) -> DataFrame:
        own = lambda df: df.where(F.col("crawl_id") == crawl_id)
        return R.crawl_summary(C.matching(self.crawl, id=crawl_id), own(self.warc), own(self.artifact), own(self.crawl_language_stats))

    def crawl_files(self, crawl_id: int, page: int = 1) -> DataFrame:
        return C.page(C.matching(self.warc, crawl_id=crawl_id), ["filename", "id"], page)

    def crawl_corrupt_files(self, crawl_id: int, page: int = 1) -> DataFrame:
        return C.page(C.matching(self.warc, crawl_id=crawl_id, warc_state_id=-2), ["id"], page)

    def crawl_languages(self, crawl_id: int) -> DataFrame:
        return C.matching(self.crawl_language_stats, crawl_id=crawl_id).orderBy(F.desc("pages"), "language")

    def data_files(self, series_ids: Sequence[int], base_url: str, page: int = 1) -> DataFrame:
        """A page of the export of the series that a client may read."""
        return C.data_api_page(self.warc, self.crawl.where(F.col("crawl_series_id").isin(list(series_ids))), base_url, page)

    def crawls_by_filename(self, filenames: Sequence[str]) -> DataFrame:
        return J.crawls_of_files(self.warc, self.crawl, list(filenames))

    def seeds(self, seedlist_id: int) -> DataFrame:
        return C.matching(self.seed, seedlist_id=seedlist_id).orderBy("surt", "id")

    def compare_seedlists(self, left: int, right: int) -> DataFrame:
        return J.compare_seedlists(C.matching(self.seed, seedlist_id=left), C.matching(self.seed, seedlist_id=right))

    def queue_page(self, page: int = 1) -> DataFrame:
        return C.page(C.matching(self.warc, warc_state_id=1), ["id"], page)

    def recalculated(self) -> tuple[DataFrame, DataFrame]:
        """Counters of all crawls and of all series, from the files."""
        return R.crawl_rollup(self.crawl, self.warc), R.series_rollup(self.crawl_series, self.crawl, self.warc)

    def _with_file_ids(self, rows: DataFrame) -> DataFrame:
        """Rows (path, filename, ...) with the catalogue's file ids. Where it knows several files of a name, the
        one counts whose path the row's ends with. Files that it doesn't know are left out."""
        n = self.warc.groupBy("filename").agg(F.count("*").alias("files"))
        known = self.warc.join(n, "filename").select(F.col("id").alias("warc_id"), F.col("filename").alias("name"), F.col("path").alias("place"), "files")
        own = (F.col("filename") == F.col("name")) & ((F.col("files") == 1) | F.coalesce(F.endswith("path", "place"), F.lit(False)))
        return rows.join(known, own).drop("name", "place", "files", "path")

    def build_index(self, path: str, target: str) -> None:
        """Index lines of all archives below a path, by file."""
        sinks.write_index_lines(self._with_file_ids(I.lines(I.captures(archive.read_records(self.spark, path)))), target)

    def build_texts(self, path: str, target: str) -> None:
        """Documents of all archives below a path, by file."""
        sinks.write_documents(self._with_file_ids(X.documents(archive.read_records(self.spark, path))), target)

    def scrub(self, path: str) -> DataFrame:
        """NEW, OK, MISMATCH or ERROR for every file of the catalogue, by what is below a path."""
        read = tables.manifest(self.spark, path).select("filename", F.col("sha256").alias("digest"))
        found = read.join(self.warc.select("id", "filename"), "filename").select("id", "digest")
        return V.scrubbed(self.warc, found)


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="webstrata", description=__doc__)
    parser.add_argument("catalogue", help="folder of the catalogue's tables")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, help_ in (("recalculate-stats", "write the counters of crawls and series"), ("build-cdx-cache", "write index lines"), ("build-text-cache", "write documents"), ("scrub", "write digests' verdicts")):
        command = commands.add_parser(name, help=help_)
        command.add_argument("target")
        if name != "recalculate-stats":
            command.add_argument("--archives", required=True, help="folder of the archives")
    a = parser.parse_args(arguments)
    catalogue = Catalogue(SparkSession.builder.appName("webstrata").getOrCreate(), a.catalogue)
    if a.command == "recalculate-stats":
        for name, counters in zip(("crawl", "crawl_series"), catalogue.recalculated()):
            counters.write.mode("overwrite").parquet(f"{a.target}/{name}_counters.parquet")
    elif a.command == "build-cdx-cache":
        catalogue.build_index(a.archives, a.target)
    elif a.command == "build-text-cache":
        catalogue.build_texts(a.archives, a.target)
    else:
        catalogue.scrub(a.archives).write.mode("overwrite").parquet(a.target)


if __name__ == "__main__":
    main()
