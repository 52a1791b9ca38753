"""Stages and operators against whole jobs: what a cut would lose."""

import time
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.helpers import ODD, frame, random_docs
from tests.llm.test_dedup import component_ids
from webstrata.llm import html_text, quality, url_filter


def test_pipeline_links_from_080(spark):
    docs = random_docs(140, seed=21) + ODD
    at_80, at_85 = component_ids(docs, 80), component_ids(docs)
    assert at_80 != at_85 == component_ids(docs, 85)
    got = corpus_pipeline.near_duplicates(spark, frame(spark, docs), "")
    assert sorted({r.doc_id for r in got.collect()}, key=str) == sorted({d for d, _ in docs if at_80[d][1] == d}, key=str)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_quality_verdicts_do_not_depend_on_size(spark, data, size):
    """Labelled documents of small tables are told apart too, and the same when every row stands there five times."""
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', size)}/{t}.parquet") for t in ("documents", "labels"))
    once = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    often = docs.crossJoin(spark.range(5).select()).select(docs.columns)
    assert often.count() == 5 * docs.count()
    assert all(r.kept == once[r.doc_id] for r in quality.judge(often, labels).collect())
    ok = {r.doc_id for r in quality.judge(docs, labels).where("not base_failed").collect()}
    verdicts = [(r.quality, once[r.doc_id]) for r in labels.where("doc_id is not null").collect() if r.doc_id in ok]
    assert (0, True) not in verdicts and (1, False) not in verdicts
    assert (0, False) in verdicts and (1, True) in verdicts


def labelled_urls():
    sites = [f"site{i}.org" for i in range(60)] + ["rare-a.net", "rare-b.net"]
    urls = [(f"http://www.{s}/{k}", 1.0 if s.startswith("rare") or i % 5 == 0 else 0.0) for i, s in enumerate(sites) for k in range(1 if s.startswith("rare") else 8)]
    return urls + urls[:30] + [(None, 1.0), ("http://x.y/1", 7.0)]


def test_suffixes_are_counted_over_all_labelled_urls(spark, monkeypatch):
    rows = labelled_urls()
    labelled = spark.createDataFrame(rows, "url string, label double").repartition(3)
    verdicts = []
    for limit in (url_filter.BROADCAST_ROWS, 1):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", limit)
        model = url_filter.fit(labelled, limit=40)
        for k, table in zip(url_filter.LEVELS, model.suffixes):
            n, bad = Counter(), Counter()
            for url, label in {r for r in rows if r[0] and r[1] in (0, 1)}:
                n[".".join(url.split("/")[2].split(".")[-k:])] += 1
                bad[".".join(url.split("/")[2].split(".")[-k:])] += label
            assert {(r.suffix, r.n, r.bad) for r in table.collect()} == {(x, n[x], bad[x]) for x in n}
        scored = url_filter.scored(labelled.select("url"), model)
        verdicts.append(sorted((r.url or "", r.n2 or 0, r.margin) for r in scored.collect()))
        assert len(verdicts[-1]) == len(rows)
    assert verdicts[0] == verdicts[1]


def test_suffix_counts_of_a_sample_leave_its_fold_out(spark):
    rows = labelled_urls()
    known = url_filter._prepared(spark.createDataFrame(sorted({r for r in rows if r[0] and r[1] in (0, 1)}), "url string, label double")).withColumn("f", url_filter._fold())
    every = known.collect()
    for r in url_filter._out_of_fold(known.drop("f"), known).collect():
        others = [x for x in every if x.suffix2 == r.suffix2 and x.f != r.fold]
        assert (r.n2 or 0, r.bad2 or 0) == (len(others), sum(x.label for x in others))


@pytest.mark.parametrize("n", [199_000, 201_000, 1_000_000])
def test_attributes_of_any_length(n):
    good = "<p>Good text for the reader of this and that, which is a good block of the page.</p>"
    text = "Good text for the reader of this and that, which is a good block of the page."
    for quote, filler in (('"', "x"), ("'", "x"), ('"', "<p>state of the page</p> ")):
        value = quote + (filler * n)[:n] + quote
        assert html_text.main_text(f'<div class="sidebar" data-state={value}>{good}</div>{good}') == text
        assert html_text.main_text(f"<article data-state={value}>{good}</article>{good}") == text
        assert html_text.main_text(f"<p>x</p><iframe srcdoc={value}>{good}</iframe>{good}") == "x " + text


def test_open_quotes_take_linear_time():
    for s in ('<a x="', "<a <a ", "<a '\"", "<div data=\"<a b='>", "<a \"x' "):
        begin = time.process_time()
        html_text.cut(s * 200_000)
        assert time.process_time() - begin < 20
