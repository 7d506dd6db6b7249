"""Stages on the smallest tables: columns, effects, order."""

import corpus_pipeline
from pagelake.llm import quality_crf

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "repeated_passages", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] <= sizes[5]
    kept = spark.read.parquet(str(tmp_path / "3"))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_on_odd_tables(spark, table):
    rows = [(1, None, "en", None, None, "x"), (1, "", None, "s", 0, "x"), (None, "a b c " * 40, "en", "s", 9, "x")]
    docs = table(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string")
    for own in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, own, DATA)
            assert out.count() <= own.count() and (i == 4 or out.columns == own.columns)


def test_quality_stage_is_the_operator(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    chain = quality_crf.train(docs, labels)
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, DATA).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in quality_crf.judge_documents(docs, chain).filter("kept").select("doc_id").collect()}


def test_all_operators_are_registered():
    from __spark_entry__ import queries

    names = set(queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
