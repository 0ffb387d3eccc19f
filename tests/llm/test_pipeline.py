"""The pipeline's stages against what each promises, on a small table."""

import corpus_pipeline
from claimloom.llm import mixing, packing, quality, secrets
from claimloom.llm.common import checkpoint
from tests.llm.helpers import odd_documents
from tests.llm.test_likeness import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_apply_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_name = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, checkpoint(stage(spark, docs, SF))
        by_name[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    before, after = by_name["quality rules"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality.report(before).where("kept").collect()}
    before, after = by_name["near-duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == brute_kept([(r.doc_id, r.text) for r in before.collect()])
    before, after = by_name["secret scan"]
    assert after.count() == before.count() and secrets.report(after).where("n_assign + n_access + n_hex > 0").count() == 0
    before, after = by_name["source mixing"]
    assert after.count() == mixing.mix(before).count()
    before, after = by_name["packing"]
    assert after.groupBy("sequence_id").agg({"length": "sum"}).where(f"`sum(length)` > {packing.CAPACITY}").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_stages_take_odd_tables(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns, each stage on the table as it is."""
    docs = odd_documents(spark)
    got = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)
    assert ids(got["quality rules"]) == ids(quality.report(docs).where("kept"))
    assert ids(got["near-duplicates"]) == sorted([0, 1, 3, 6, 7, None], key=repr)  # one of the foxes, one of the texts without words
    assert ids(got["secret scan"]) == ids(docs) and {r.text for r in got["secret scan"].collect()} == {r.text for r in docs.collect()}
    assert ids(got["source mixing"]) == ids(mixing.mix(docs).select("row.doc_id"))
    held = got["packing"].selectExpr("count(*) AS n", "sum(length) AS length", "sum(IF(start = 0, doc_tokens, 0)) AS tokens").first()
    assert held.n >= docs.count() and held.length == held.tokens
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
