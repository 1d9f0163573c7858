"""The pipeline against its operators, stage by stage."""

import corpus_pipeline
from opledger.llm import decontamination, near_duplicates, packing, quality_rules, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0").collect()}
        elif name == "quality_rules":
            want = {r.doc_id for r in quality_rules.quality_rules(before).filter("kept").collect()}
        elif name == "near_duplicates":
            want = {r.class_id for r in near_duplicates.near_duplicates(before).collect()}
        else:
            want = {r.doc_id for r in decontamination.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("not contaminated").collect()}
        got = [r.doc_id for r in docs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    pieces = {tuple(r) for r in packing.pack_documents(docs).select("doc_id", "start", "length", "ids_crc32").collect()}
    assert pieces and {r[0] for r in pieces} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).agg({"length": "sum"}).first()[0] == sum(r[2] for r in pieces)
