import corpus_pipeline

from scorewell.llm.queries import catalog


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_run_gives_what_the_stages_give(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ends = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and ends[0][0] == 0


def test_one_document_of_each_group_stays(spark, docs, rows):
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    ids = [r.doc_id for r in kept]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert 7 in ids and not any(200 <= i < 215 for i in ids if i is not None) and None in ids


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries) == list(range(1, 14))
