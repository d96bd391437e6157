import corpus_pipeline
from ledgerscope.llm import packing


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            assert 0 < out.count()
            docs = out
    assert out.select(*[c.split()[0] for c in packing.PIECES.split(", ")]).count() >= docs.count()
