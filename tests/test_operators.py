import pytest
from pyspark.sql import functions as F

from webstrata.operators import catalogue as C
from webstrata.operators import joins as J
from webstrata.operators import rollup as R
from webstrata.operators import verify as V
from webstrata.streaming import feeds


def test_lock_expiry(spark):
    now = 1_700_000_000
    locks = spark.createDataFrame([("young", "a", now - 60), ("old", "b", now - 121)], "name string, owner string, checkin_time long")
    assert [r.name for r in V.live_locks(locks, now).collect()] == ["young"]
    wanted = spark.createDataFrame([("young", "c"), ("old", "d"), ("old", "c")], "name string, owner string")
    assert [(r.name, r.owner) for r in V.acquired(locks, wanted, now).collect()] == [("old", "c")]
    assert not V.sweep_due(0, 299_999) and V.sweep_due(0, 300_000)


def test_seed_lists_are_bags(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, surt string")
    right = spark.createDataFrame([(7, "a"), (8, "c"), (9, "c")], "id long, surt string")
    got = sorted((r.side, r.surt, r.left_id, r.right_id) for r in J.compare_seedlists(left, right).collect())
    assert got == [("common", "a", 1, 7), ("left", "a", 2, None), ("left", "b", 3, None), ("right", "c", None, 8), ("right", "c", None, 9)]


def test_last_seed_of_a_key_counts(spark):
    seeds = spark.createDataFrame([(1, "a", "k"), (2, "b", "k"), (3, "c", None), (4, "d", "m")], "id long, surt string, key string")
    titles = spark.createDataFrame([(10, "t", "k"), (11, "u", None)], "pi long, name string, key string")
    assert [(r.seed_id, r.pi) for r in J.seeds_with_titles(seeds, titles).collect()] == [(2, 10)]
    assert [r.seed_id for r in J.seeds_without_title(seeds, titles).collect()] == [4]


def test_deltas_of_a_deletion(spark):
    schema = "id long, crawl_id long, warc_state_id int, size long, records long, record_bytes long"
    crawls = spark.createDataFrame([(1,), (2,)], "id long")
    before = spark.createDataFrame([(1, 1, 2, 10, 3, 30), (2, 1, 2, 20, 4, 40)], schema)
    after = spark.createDataFrame([(1, 1, -4, 10, 3, 30), (2, 1, 2, 25, 4, 40), (3, 2, 1, 5, 0, 0)], schema)
    deltas = R.file_deltas(before, after).withColumnRenamed("crawl_id", "id")
    got = sorted(map(tuple, R.apply_deltas(R.crawl_rollup(crawls, before), deltas).collect()))
    assert got == sorted(map(tuple, R.crawl_rollup(crawls, after).collect())) == [(1, 1, 25, 4, 40), (2, 1, 5, 0, 0)]


def test_pager(spark):
    for n, last in ((0, 1), (100, 1), (101, 2), (200, 2)):
        assert C.pager(spark.range(n)).first().last_page == last


def test_states(spark):
    df = spark.createDataFrame([(2,), (-4,), (9,)], "s int")
    assert [r.n for r in df.select(C.state_name(F.col("s")).alias("n")).collect()] == ["cdx_indexed", "deleted", "unknown_9"]


def test_latest_state_before_filter(spark):
    """A file whose newest state is low is not in the feed, though an older one was high."""
    history = spark.createDataFrame([(1, 5, "2024-01-01 00:00:00", 3), (2, 5, "2024-01-02 00:00:00", -4), (3, 6, "2024-01-03 00:00:00", 2)], "id long, warc_id long, time string, warc_state_id int").withColumn("time", F.col("time").cast("timestamp_ntz"))
    warcs = spark.createDataFrame([(5, 1, 10), (6, 1, 20)], "id long, crawl_id long, records long")
    crawls, members = spark.createDataFrame([(1, 4)], "id long, crawl_series_id long"), spark.createDataFrame([(8, 4), (8, 4)], "collection_id long, crawl_series_id long")
    assert [(r.warc_id, r.url_count) for r in J.sync_feed(history, warcs, crawls, members, 8).collect()] == [(6, 20)]
    assert J.sync_feed(history, warcs, crawls, members, 8, start_time="2024-01-03 00:00:00", start_id=6).collect() == []
    plan = J.sync_feed(history, warcs, crawls, members, 8)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def test_rollup_plan(spark):
    """One aggregate of the files and one join, not one for each counter."""
    schema = "id long, crawl_id long, warc_state_id int, size long, records long, record_bytes long"
    plan = R.crawl_rollup(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], schema))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1


def test_filters_reach_the_scan(spark, data):
    from webstrata.plans.fixtures import Views

    plan = C.matching(Views(spark, data).crawl, id=7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,7)" in plan


@pytest.mark.parametrize("sizes,expected", [([5, 7, 7, 6, 9], 9), ([3], 3)])
def test_growing_files(spark, tmp_path, sizes, expected):
    for i, n in enumerate(sizes):
        spark.createDataFrame([("f", n)], "path string, size long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.grown_files(feeds.table_stream(spark, str(tmp_path / "in"), "path string, size long", 1))
    feeds.run_once(stream, feeds.append_once(str(tmp_path / "out")), str(tmp_path / "state"), "update")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert max(r["size"] for r in rows) == sum(r.delta for r in rows) == expected


def test_index_queue_resumes(spark, tmp_path):
    """Archives are indexed once, also when the stream is started again."""
    import gzip

    from webstrata.sources import archive
    from webstrata.operators import capture_index as I

    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://x.y/%d\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/plain\r\nContent-Length: 1\r\n\r\na\r\n\r\n"
    top = tmp_path / "in"
    top.mkdir()
    index = lambda files: I.lines(I.captures(archive.parsed(files)))
    for i in range(2):
        (top / f"{i}.warc.gz").write_bytes(gzip.compress(record % (i, i)))
        feeds.index_queue(spark, str(top), str(tmp_path / "state"), str(tmp_path / "out"), index)
        assert sorted(r.filename for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"{k}.warc.gz" for k in range(i + 1)]


def test_back_off(spark, tmp_path):
    spark.createDataFrame([(1, 0, True), (1, 100, False), (2, 50, False), (3, 0, True), (3, 3600, False)], "warc_id long, at long, failed boolean").write.parquet(str(tmp_path / "in"))
    stream = feeds.retries(feeds.table_stream(spark, str(tmp_path / "in"), "warc_id long, at long, failed boolean"))
    feeds.run_once(stream, feeds.append_once(str(tmp_path / "out")), str(tmp_path / "state"), "update")
    assert {r.warc_id: r.due for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: False, 2: True, 3: True}


def test_only_repeated_indexing_collapses(spark):
    rows = [(1, 5, 2), (2, 5, 2), (3, 5, -2), (4, 5, -2), (5, 5, 2), (6, 6, 2), (7, 5, None), (8, 5, 2)]
    history = spark.createDataFrame(rows, "id long, warc_id long, warc_state_id int")
    assert sorted(r.id for r in C.collapse_states(history).collect()) == [2, 3, 4, 5, 6, 7, 8]
    assert sorted(r.id for r in C.collapse_states(history, -2).collect()) == [1, 2, 4, 5, 6, 7, 8]


def test_states_of_history(spark):
    files = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "id long, warc_state_id int, filename string")
    history = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 9, 2)], "id long, warc_id long, warc_state_id int")
    out = C.with_states(files, history)
    assert out.columns == files.columns
    assert sorted(map(tuple, out.collect())) == [(1, 3, "a"), (2, 1, "b")]


def test_updated(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "id long, name string, n int")
    changes = spark.createDataFrame([("x", 2), ("z", 2), (None, 1), ("new", 9)], "name string, id long")
    assert sorted(map(tuple, R.updated(table, changes, ["id"]).collect()), key=str) == [(1, None, 5), (2, "z", 6), (3, None, 7)]
    assert sorted(map(tuple, R.updated(table, changes.limit(0), ["id"]).collect()), key=str) == sorted(map(tuple, table.collect()), key=str)


@pytest.mark.parametrize("host,expected", [("a.b.com.sg", "b.com.sg"), ("com.sg", "com.sg"), ("x.y.k.z.us", "y.k.z.us"), ("q.z.us", "z.us"), ("www.a.co.uk", "co.uk"), ("1.2.3.4", "1.2.3.4")])
def test_site_by_own_suffixes(spark, host, expected):
    from webstrata.functions import urls as U

    df = spark.createDataFrame([(f"http://{host}/",)], "url string")
    assert df.select(U.site(F.col("url"), ["com.sg", "k.z.us"]).alias("s")).first().s == expected
