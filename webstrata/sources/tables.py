"""Manifests, job folders, seed texts, language archives, JDBC and JSON as DataFrames."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.binary import is_gzip, sha256_hex
from webstrata.functions.urls import add_implicit_scheme


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, filename, size, sha256, gzip, modified, warc_state_id) of the files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("size"), sha256_hex(F.col("content")).alias("sha256"), is_gzip(F.col("content")).alias("gzip"),
        F.col("modificationTime").alias("modified"), F.lit(1).alias("warc_state_id"),
    )


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified) of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def job_files(files: DataFrame) -> DataFrame:
    """(job, launch, path, size): the archives of crawl jobs, `<job>/<14 digits>/warcs/*.warc.gz`, from a listing."""
    pattern = r"^(.*)/(\d{14})/warcs/[^/]*\.warc\.gz$"
    return files.where(F.col("path").rlike(pattern)).select(F.substring_index(F.regexp_extract("path", pattern, 1), "/", -1).alias("job"), F.regexp_extract("path", pattern, 2).alias("launch"), "path", "size")


def jobs(files: DataFrame) -> DataFrame:
    """(job, modified): job folders, the last modified first."""
    own = files.where(F.col("path").rlike(r"/\d{14}/")).select(F.substring_index(F.regexp_extract("path", r"^(.*?)/\d{14}/", 1), "/", -1).alias("job"), "modified")
    return own.groupBy("job").agg(F.max("modified").alias("modified")).orderBy(F.desc("modified"), "job")


def bundle_files(files: DataFrame) -> DataFrame:
    """Of a job's files those for its bundle: nothing directly in folders named state or warcs, and no *.jdb."""
    return files.where(~F.substring_index(F.substring_index("path", "/", -2), "/", 1).isin("state", "warcs") & ~F.col("path").endswith(".jdb"))


def location(blob_id: Column, base_url: Column, filename: Column, path: Column) -> Column:
    """Where to read a file: its blob, else below an HTTP base, else its local path."""
    return F.coalesce(F.concat(F.lit("blob:"), blob_id.cast("string")), F.concat(base_url, filename), path)


def seeds_from_text(texts: DataFrame) -> DataFrame:
    """(seedlist_id, url) from (seedlist_id, text): a line each, trimmed, with implied scheme, once for each list."""
    lines = texts.select("seedlist_id", F.explode(F.split("text", "\r?\n")).alias("line")).select("seedlist_id", F.trim("line").alias("line")).where("line <> ''")
    return lines.select("seedlist_id", add_implicit_scheme(F.col("line")).alias("url")).distinct()


def language_lines(files: DataFrame) -> DataFrame:
    """(path, language, pages) of tar.gz files (path, content): lines of each entry named `<language>.txt`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    for entry in tar:
                        if entry.isfile() and entry.name.endswith(".txt"):
                            rows.append((path, entry.name.rsplit("/", 1)[-1].removesuffix(".txt"), len(tar.extractfile(entry).read().splitlines())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["path", "language", "pages"])

    return files.select("path", "content").mapInArrow(run, "path string, language string, pages long").groupBy("path", "language").agg(F.sum("pages").alias("pages"))


def zip_entries(files: DataFrame) -> DataFrame:
    """(path, entry) of zip files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, n) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n in zipfile.ZipFile(io.BytesIO(c)).namelist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["path", "entry"])

    return files.select("path", "content").mapInArrow(run, "path string, entry string")


def registry_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of the registry over JDBC, streamed 500 rows at a time. For a large table give
    partitionColumn, lowerBound, upperBound and numPartitions, so that executors share the read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="500", **options).load()


def cached_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents from files that hold a JSON array each; malformed files give a row of nulls."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def cache_metadata(entries: DataFrame) -> DataFrame:
    """(path, meta) from (path, value): the JSON of a cache entry; null, as if missing, where it can't be read."""
    meta = F.from_json("value", "warcId long, size long, sha256 string", {"mode": "PERMISSIVE"})
    return entries.select("path", F.when(meta["warcId"].isNotNull(), meta).alias("meta"))
