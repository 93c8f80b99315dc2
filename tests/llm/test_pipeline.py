import re

from pyspark.sql import functions as F

import corpus_pipeline
from chalkline.llm import secrets, simhash, toxicity
from tests.llm.fixture import documents


def test_stages_take_effect_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "secret_scan", "mixing", "packing"]
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i > 110)) for i in range(0, 132, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.toxicity_model(read, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = stage["toxicity"](spark, read, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in read.collect() if model.score([(r.text or "").encode()])[0] < toxicity.THRESHOLD)
    now = spark.createDataFrame(kept, read.schema)
    one = stage["simhash_dedup"](spark, now, str(tmp_path)).collect()
    labels = {r.doc_id: r.component_id for r in simhash.near_duplicates(now).collect()}
    assert len(one) == len({v for v in labels.values()}) and len({r.doc_id for r in one}) == len(one)
    now = spark.createDataFrame(one, read.schema)
    clean = {r.doc_id: r for r in stage["secret_scan"](spark, now, str(tmp_path)).collect()}
    assert {k: None if r.text is None else r.text for k, r in clean.items()} == {r.doc_id: None if r.text is None else secrets.redact(r.text) for r in one}
    now = spark.createDataFrame(list(clean.values()), read.schema)
    mixed = stage["mixing"](spark, now, str(tmp_path))
    assert mixed.columns == read.columns and mixed.where("n_chars <> length(text)").count() == 0
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert abs(sum(words(r.text) for r in mixed.collect()) - 1.5 * sum(words(r.text) for r in clean.values())) <= 5
    packed = stage["packing"](spark, mixed, str(tmp_path))
    assert packed.where("piece = 0").count() == mixed.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_empty_documents(spark, tmp_path):
    documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
