"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline as pipeline
from conftest import DATA
from pyspark.sql import functions as F
from test_neardup import brute, shingled

from rivulet.llm import langid, pii
from rivulet.llm.common import durable

D = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {"documents": docs}
    for name, stage in pipeline.STAGES:
        docs = kept[name] = durable(stage(spark, docs, D), f"test-{name}")
        if name != "packing":
            assert docs.columns == kept["documents"].columns
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").collect()) for k, v in kept.items()}
    told = langid.identify(kept["documents"].select("doc_id", "text", "lang"))
    assert ids["language"] == sorted(r.doc_id for r in told.where("lang_pred <> 'und' AND score >= 0.4").collect())
    assert len(ids["language"]) > 0.95 * len(ids["documents"])
    rows = sorted(kept["language"].select("doc_id", "text").collect())
    assert ids["near_dedup"] == [r.doc_id for i, (r, root) in enumerate(zip(rows, brute([shingled(r.text) for r in rows]), strict=True)) if i == root]
    assert ids["pseudonyms"] == ids["near_dedup"]
    found = kept["pseudonyms"].join(kept["near_dedup"].select("doc_id", F.col("text").alias("before")), "doc_id").where(pii.found_count(pii.matches(F.col("before"))) > 0).collect()
    assert found and all(r.text != r.before for r in found if "@" in r.before)
    assert set(ids["mixing"]) <= set(ids["pseudonyms"]) and set(ids["packing"]) == set(ids["mixing"])


def test_edges(spark):
    base = spark.read.parquet(f"{D}/documents.parquet")
    some = base.limit(60)
    odd = spark.createDataFrame([(70, "word " * 300_000 + "the and of to in that is was he for it with as his on be at by", "en", "z", 1), (None, None, None, None, None), (7, "", None, None, 0), (8, "!! 12", None, None, 0), (None, "Abc def", "en", "z", 1)], base.schema)
    docs = some.unionByName(some.limit(20)).unionByName(odd).withColumn("score", F.lit("x")).withColumn("size", F.lit(1)).withColumn("lang_pred", F.lit(2))
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, D), f"edge-{name}")
        assert docs.columns == columns
        if name == "near_dedup":
            assert docs.groupBy("doc_id", "text").count().where("count > 1").count() == 0  # one row of equal texts, all unlike ones
    assert pipeline.pack_sequences(spark, docs, D).count() > 0
    empty = base.where("false")
    for name, stage in pipeline.STAGES:
        empty = durable(stage(spark, empty, D), f"empty-{name}")
        assert empty.count() == 0


def test_run_is_whole(spark):
    out = pipeline.run(spark, D)
    assert out.count() > 0 and pipeline.ORACLE_SQL is None
