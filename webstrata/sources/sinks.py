"""Index lines, documents, plain-text exports and bundles as files.

Everything is written by Spark's writers, whose commit protocol makes outputs appear
whole; HTTP publication goes partition by partition and may repeat, which the index
server's upserts allow.
"""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_index_lines(lines: DataFrame, path: str) -> None:
    """Lines (warc_id, line) as gzip text, in a folder for each thousand files: `bucket=000`."""
    bucket = F.lpad(F.expr("warc_id div 1000").cast("string"), 3, "0")
    lines.select(F.col("line").alias("value"), bucket.alias("bucket")).write.partitionBy("bucket").option("compression", "gzip").mode("overwrite").text(path)


def publish(lines: DataFrame, url: str, send=None, batch: int = 10_000) -> int:
    """POST lines (line) to an index server in batches; an answer other than 200 is an error, which the
    task's retry repeats. Returns the number of lines, counted while they are sent."""
    send = send or _post
    sent = lines.sparkSession.sparkContext.accumulator(0)

    def run(rows: Iterator) -> None:
        part: list[str] = []
        for r in rows:
            part.append(r.line)
            if len(part) >= batch:
                send(url, "\n".join(part) + "\n")
                sent.add(len(part))
                part = []
        if part:
            send(url, "\n".join(part) + "\n")
            sent.add(len(part))

    lines.select("line").foreachPartition(run)
    return sent.value


def _post(url: str, body: str) -> None:
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "text/plain"})
    with urllib.request.urlopen(request) as answer:
        if answer.status != 200:
            raise OSError(f"{url} answered {answer.status}")


def deletions(lines: DataFrame) -> DataFrame:
    """The lines to send to `<url>/delete`: those of captures; aliases stay."""
    return lines.where(~F.col("line").startswith("@alias"))


def remaining(index: DataFrame, deleted: DataFrame) -> DataFrame:
    """An index (line) without the lines of a deletion."""
    return index.join(deletions(deleted).select("line"), "line", "left_anti")


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as a Parquet table with a folder for each thousand files."""
    documents.withColumn("bucket", F.expr("warc_id div 1000")).write.partitionBy("bucket").mode("overwrite").parquet(path)


def json_documents(documents: DataFrame) -> DataFrame:
    """(warc_id, json): a file's documents as one JSON array, in order of their position."""
    fields = [c for c in documents.columns if c != "warc_id"]
    rows = F.array_sort(F.collect_list(F.struct("position", F.to_json(F.struct(*fields)).alias("j"))))
    return documents.groupBy("warc_id").agg(F.concat(F.lit("["), F.array_join(rows["j"], ","), F.lit("]")).alias("json"))


def language_line(language: Column, pages: Column) -> Column:
    """`%-12s %d`."""
    return F.format_string("%-12s %d", language, pages)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def zip_manifest(files: DataFrame) -> DataFrame:
    """(filename, size, crc32) of files (filename, content): what a stored zip entry needs beforehand."""
    return files.select("filename", F.length("content").cast("long").alias("size"), F.crc32("content").alias("crc32"))


def stored_blobs(manifest: DataFrame, stored: DataFrame, delete_original: bool = False) -> DataFrame:
    """The manifest (id, path, sha256) with the blob ids of a store (blob_id, id, sha256) whose digest agrees; with
    delete_original their paths go."""
    same = stored.select("id", F.col("sha256").alias("_d"), "blob_id")
    out = manifest.drop("blob_id").join(same, "id", "left")
    ok = F.col("_d") == F.col("sha256")
    path = F.when(F.coalesce(ok, F.lit(False)) & F.lit(delete_original), None).otherwise(F.col("path"))
    return out.select("id", path.alias("path"), "sha256", F.when(ok, F.col("blob_id")).alias("blob_id"))
