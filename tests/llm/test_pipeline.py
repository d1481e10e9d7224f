"""Each stage on its own input, at the smallest scale."""

import corpus_pipeline
from tracewell.scratch import cut

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = cut(stage(spark, docs, DIR), "t-stage")
        now = out.count()
        assert 0 < now <= seen, name
        assert out.columns[: len(columns)] == columns and (n == 4) == (len(out.columns) > len(columns))
        assert out.select("doc_id").distinct().count() == now
        docs, seen = out, now
    assert docs.filter("taken <= 0").count() == 0
    empty = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0, name
