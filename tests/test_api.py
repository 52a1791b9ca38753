import gzip

import pytest

from webstrata import api
from webstrata.plans.schema import TABLES

RECORD = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://x.y/{0}\r\nWARC-Record-ID: <urn:{0}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: 8\r\n\r\n<p>a</p>\r\n\r\n"
ROWS = {
    "crawl_series": [dict(id=1, name="s", agency_id=4), dict(id=2, name="r")],
    "crawl": [dict(id=1, name="c", crawl_series_id=1, state=0), dict(id=2, name="d", crawl_series_id=1)],
    "warc": [dict(id=i, crawl_id=1 + i % 2, warc_state_id=s, size=10 * i, records=i, record_bytes=i, filename=f"{i}.warc.gz", sha256="x" if i == 1 else None) for i, s in ((1, 1), (2, 2), (3, -4), (1001, -2))],
    "collection": [dict(id=5, name="k")],
    "collection_series": [dict(collection_id=5, crawl_series_id=1)],
    "artifact": [dict(id=1, crawl_id=2, size=7)],
    "crawl_language_stats": [dict(crawl_id=2, language="en", pages=3), dict(crawl_id=2, language="de", pages=3)],
    "seed": [dict(id=1, seedlist_id=1, url="http://a.b", surt="(b,a,"), dict(id=2, seedlist_id=2, url="http://a.b", surt="(b,a,")],
}


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("catalogue")
    for name, schema in TABLES.items():
        columns = [c.split()[0] for c in schema.split(", ")]
        rows = [tuple(r.get(c) for c in columns) for r in ROWS.get(name, [])]
        spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    spark.sql("select 1L id, 2L warc_id, timestamp_ntz'2024-01-01 00:00:00' time, 2 warc_state_id").write.mode("overwrite").parquet(f"{top}/warc_history.parquet")
    return api.Catalogue(spark, str(top))


def test_pages(catalogue):
    assert tuple(catalogue.home().first()) == (4, 10047, 1004)
    assert catalogue.health().first().id == 1
    assert [r.id for r in catalogue.collections_page().collect()] == [5]
    assert [r.id for r in catalogue.collection_files(5, 2).collect()] == [2, 3, 1001]
    assert [r.resumption_token for r in catalogue.collection_sync(5).collect()] == ["2024-01-01T00:00:00Z,2"]
    assert catalogue.collection_sync(5, ("2024-01-01 00:00:00", 2)).collect() == []
    assert [(r.id, r.crawl_count) for r in catalogue.series_page(4).collect()] == [(1, 2)]
    assert [r.id for r in catalogue.series_page(see_all=True).collect()] == [2, 1]
    assert [r.id for r in catalogue.series_crawls(1).collect()] == [2, 1]
    assert [r.id for r in catalogue.series_collections(1).collect()] == [5]
    assert [r.series_name for r in catalogue.crawls_page().collect()] == ["s", "s"]
    assert tuple(catalogue.crawl_summary(2).first()) == (2, 1, 1, 1, 7, 2)
    assert [r.id for r in catalogue.crawl_files(2).collect()] == [1, 1001, 3]
    assert [r.id for r in catalogue.crawl_corrupt_files(2).collect()] == [1001]
    assert [r.language for r in catalogue.crawl_languages(2).collect()] == ["de", "en"]
    assert [r.url for r in catalogue.data_files([1], "http://h").collect()][0] == "http://h/data/warcs/1"
    assert [r.crawl_name for r in catalogue.crawls_by_filename(["2.warc.gz"]).collect()] == ["c"]
    assert catalogue.seeds(1).count() == 1 and [r.side for r in catalogue.compare_seedlists(1, 2).collect()] == ["common"]
    assert [r.id for r in catalogue.queue_page().collect()] == [1]
    with pytest.raises(AttributeError):
        catalogue.nothing


def test_commands(spark, catalogue, tmp_path):
    archives = tmp_path / "in"
    archives.mkdir()
    for i in (1, 2, 1001, 77):
        (archives / f"{i}.warc.gz").write_bytes(gzip.compress(RECORD.format(i).encode()))
    out = str(tmp_path / "out")
    api.main([catalogue.folder, "recalculate-stats", f"{out}/stats"])
    assert sorted(map(tuple, spark.read.parquet(f"{out}/stats/crawl_counters.parquet").collect())) == [(1, 1, 20, 2, 2), (2, 2, 10020, 1002, 1002)]
    api.main([catalogue.folder, "build-cdx-cache", f"{out}/cdx", "--archives", str(archives)])
    assert sorted(r.value.split(" ")[2] for r in spark.read.text(f"{out}/cdx").collect()) == ["http://x.y/1", "http://x.y/1001", "http://x.y/2"]
    api.main([catalogue.folder, "build-text-cache", f"{out}/text", "--archives", str(archives)])
    assert {(r.warc_id, r.text) for r in spark.read.parquet(f"{out}/text").collect()} == {(1, "a"), (2, "a"), (1001, "a")}
    api.main([catalogue.folder, "scrub", f"{out}/scrub", "--archives", str(archives)])
    assert {(r.id, r.result) for r in spark.read.parquet(f"{out}/scrub").collect()} == {(1, "MISMATCH"), (2, "NEW"), (3, "ERROR"), (1001, "NEW")}
