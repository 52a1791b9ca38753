"""Tables in the folder that all machines of the cluster share, and distributed components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Let the session send Python at most ARROW_ROWS rows at once, so that a batch of long texts fits in memory
    next to what is made of it. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def folder(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir; only where that is not set in local mode (tests) a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not top:
        top = getattr(spark, "_webstrata_folder", None) or tempfile.mkdtemp(prefix="webstrata-")
        spark._webstrata_folder = top
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared folder: lost executors lose nothing."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by `written` that nothing reads any more."""
    spark = df.sparkSession
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _fingerprint(edges: DataFrame) -> tuple:
    """Number and sums of the rows (a, b): one row, by which equal sets of links are known."""
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), exact(F.col("a")), exact(F.col("b")), exact(F.xxhash64("a", "b")), exact(F.xxhash64("b", "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, root): for each id of the undirected links (a, b), the smallest id that it reaches.

    Alternates two steps until nothing changes: every id hangs its larger neighbours on
    its smallest neighbour, then its smaller neighbours and itself. Each step is one
    shuffle with a partial minimum; the rows never exceed the links, no id's neighbours
    are collected, and the number of rounds grows with the logarithm of a path's length.
    Links with nulls must not be given; repeated links and links of an id to itself are allowed."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = _fingerprint(edges)
    while True:
        # every id's smallest neighbour or itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        after = written(small)
        forget(edges)
        edges, before, was = after, was, _fingerprint(after)
        if was == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
