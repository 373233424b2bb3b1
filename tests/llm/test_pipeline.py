import pytest
from pyspark.sql import functions as F

from starmill.llm.store import Store

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, store = docs.columns, Store(spark, "t")
    assert [k for k, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicate documents", "benchmark decontamination", "mixing to target weights"]
    seen = [docs.count()]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = store.keep(stage(spark, docs, small), "s")
        seen.append(docs.count())
        if i < 4:
            assert docs.columns == names
        if i != 1:
            assert seen[-1] < seen[-2]
    assert docs.columns[: len(names)] == names
    assert docs.filter(F.col("n_chars") != F.length("text")).isEmpty()
    assert sorted(r[0] for r in pipeline.run(spark, small).select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_odd_rows(spark, odd, tmp_path, small):
    folder = f"file://{tmp_path}/in"
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").limit(0).write.parquet(f"{folder}/benchmark.parquet")
    assert pipeline.run(spark, folder).columns[:2] == ["doc_id", "text"]
    odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert pipeline.run(spark, folder).isEmpty()
