import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_pipeline_keeps_what_its_stages_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, at, SF))
        if name != "sharding":
            assert out.columns == docs.columns, name
        frames[name], at = out, out
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = lambda n: {r["doc_id"] for r in frames[n].collect()}
    assert len(ids("language_id")) >= 0.98 * len(texts)
    near = ids("ngram_jaccard_join")
    assert len({texts[i] for i in near}) == len(near)
    clean = ids("benchmark_decontamination")
    assert not any(b in (texts[i] or "") for i in clean for b in bench) and clean >= {i for i in near if not any(b[:60].lower() in (texts[i] or "").lower() for b in bench)}
    assert ids("mixing") <= clean
    shards = [r["count"] for r in frames["sharding"].groupBy("shard").count().collect()]
    assert max(shards) - min(shards) <= 1 and sum(shards) == frames["mixing"].count()
