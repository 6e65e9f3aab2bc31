"""The pipeline's stages on the smallest tables, each against what its own input says."""

import corpus_pipeline
from workloom.llm import catalog, decontaminate, near, templates, toxicity
from workloom.llm.frames import table
from workloom.session import stash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stash(stage(spark, before, SF), "stage")
        assert docs.columns == columns
        seen[name] = before, docs
    before, after = seen["toxicity"]
    model = toxicity.train(before, table(spark, SF, "labels"))
    assert after.count() == toxicity.score(before, model).where("toxicity < 0.7").count()
    before, after = seen["line_dedup"]
    assert after.count() == before.count()
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: r.text for r in templates.drop_repeated_lines(before).collect()}
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.class_id for r in near.classes(before).collect()}
    before, after = seen["decontamination"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(
        r.doc_id for r in decontaminate.clean_documents(before, table(spark, SF, "benchmark")).collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_queries_cover_whole_tables(spark):
    for name in ("op1_text_blocks", "op5_link_trust"):
        assert catalog.QUERIES[name](spark, SF).count() == table(spark, SF, "pages").count()
    for name in ("op2_line_templates", "op4_suffix_runs", "op7_order_minhash", "op8_decontaminate", "op9_toxicity", "op10_bayes_quality"):
        assert catalog.QUERIES[name](spark, SF).count() == table(spark, SF, "documents").count()
