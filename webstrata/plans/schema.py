"""The tables of a catalogue, as Spark DDL. Counters are derived and aren't stored."""

TABLES = {
    "agency": "id long, name string, abbreviation string, url string, logo binary",
    "collection": "id long, name string, description string, cdx_url string",
    "crawl_series": "id long, name string, path string, description string, creator string, created timestamp_ntz, modifier string, modified timestamp_ntz, agency_id long",
    "crawl": "id long, name string, total_docs long, total_bytes long, crawl_series_id long, path string, state int, description string, start_time timestamp_ntz, end_time timestamp_ntz, instance_id long, creator string, created timestamp_ntz, modifier string, modified timestamp_ntz, agency_id long, capture_tool_id string",
    "warc": "id long, crawl_id long, warc_state_id int, path string, size long, records long, record_bytes long, filename string, sha256 string, blob_id long, start_time timestamp_ntz, end_time timestamp_ntz, software string",
    "warc_history": "id long, warc_id long, time timestamp_ntz, warc_state_id int",
    "collection_series": "collection_id long, crawl_series_id long, url_filters string",
    "collection_warc": "collection_id long, warc_id long, records long, record_bytes long",
    "artifact": "id long, crawl_id long, type string, path string, size long, sha256 string, blob_id long, relpath string, last_modified timestamp_ntz",
    "seedlist": "id long, name string, total_seeds long, description string",
    "seed": "id long, url string, surt string, seedlist_id long",
    "crawl_language_stats": "crawl_id long, language string, pages long",
    "task": "id long, name string, enabled boolean, start_time timestamp_ntz, finish_time timestamp_ntz",
    "named_lock": "name string, owner string, checkin_time long, acquire_time long",
    "import_task": "id long, job_path string, crawl_series_id long, state int",
}
