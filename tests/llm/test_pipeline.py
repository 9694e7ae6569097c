"""The pipeline's stages keep what they should, on the smallest tables."""

import corpus_pipeline


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, [{r["doc_id"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids and ids <= seen[-1], name
        seen.append(ids)
        if name != "sharding":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    per = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(per) - min(per) <= 1
