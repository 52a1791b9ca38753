import corpus_pipeline
from tests.llm.helpers import ODD, frame, random_docs
from tests.llm.test_dedup import component_ids, removed_bytes
from tests.llm.test_text import brute_measures, contaminated
from webstrata.llm import quality, shared


def test_stages_equal_brute_force(spark, tmp_path):
    docs = [(i, " ".join([t] * (1 if len(t.split()) > 60 else 3))) for i, t in random_docs(140, seed=21)] + ODD
    items = [(1, " ".join(docs[7][1].split()[2:15])), (2, "nothing of this stands anywhere in the texts of this corpus today")]
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = frame(spark, docs).withColumnRenamed("bucket", "lang").withColumnRenamed("id", "source")
    df.write.parquet(str(tmp_path / "documents.parquet"))

    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    rows = list(docs)
    for name, stage in corpus_pipeline.STAGES:
        now = shared.written(stage(spark, now, str(tmp_path)))
        if name == "quality rules":
            score = {r.doc_id: r.kept for r in quality.judge(frame(spark, docs), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
            rows = [(d, t) for d, t in rows if not brute_measures(t)[-1] and score[d]]
        elif name == "near duplicates":
            keep = component_ids(rows, percent=80)
            rows = [(d, t) for d, t in rows if keep[d][1] == d]
        elif name == "repeated passages":
            expected = removed_bytes(rows)
            got = {r.doc_id: r.text for r in now.collect()}
            for d, t in rows:
                # cut characters stay, so a text may keep a few bytes more
                assert expected[d][0] - expected[d][1] <= len(got[d].encode()) <= expected[d][0] - expected[d][1] + 4 * expected[d][2]
            rows = [(d, got[d]) for d, _ in rows]
        elif name == "decontamination":
            rows = [(d, t) for d, t in rows if not contaminated([(d, t)], items)[0][5]]
        if name != "tokens":
            assert now.columns == columns
            assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(rows), name
    assert sorted(r.doc_id for r in now.collect()) == sorted(d for d, _ in rows)
    assert 10 < len(rows) < len(docs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)
