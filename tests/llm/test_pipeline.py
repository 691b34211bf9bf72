from pyspark.sql import functions as F

import corpus_pipeline
from tilewise.llm import storage

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, storage.written(stage(spark, now, SF), name)
        assert now.columns == docs.columns and {r[0] for r in now.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        counts.append(now.count())
    assert counts[0] == 200 and counts[1] < 200 and counts[2] < counts[1] and counts[3] == counts[2]
    packed = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in now.select("doc_id").collect()}


def test_documents_without_language_go(spark, odd):
    frame = odd.selectExpr("doc_id", "text", "CASE WHEN doc_id > 3 THEN 'en' END AS lang", "kind AS source", "length(text) AS n_chars")
    kept = corpus_pipeline.identify_language(spark, frame, SF)
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 6, 7, None}


def test_stages_beside_other_columns(spark, docs):
    """Columns whose names the stages use themselves, or that need quotes, pass through unchanged."""
    names = ["a.b", "score", "lang_pred", "depth", "component_id"]
    frame = docs.limit(40).select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    now = storage.written(frame, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = storage.written(stage(spark, now, SF), name)
        assert now.columns == frame.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in now.collect() for n in names)


def test_what_each_stage_decides(spark):
    text = "the old house stands by the river and nobody has lived in it for many long years since then"
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, text), (2, text), (3, text + " indeed"), (4, "12 34 ½"), (5, passage), (6, "write to someone@example.org about the garden behind the house"), (7, "a quite different text about trees and birds")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(corpus_pipeline.identify_language(spark, frame, SF)) == [1, 2, 3, 5, 6, 7]
    assert ids(corpus_pipeline.drop_near_duplicates(spark, frame, SF)) == [1, 4, 5, 6, 7]
    assert ids(corpus_pipeline.drop_benchmark_passages(spark, frame, SF)) == [1, 2, 3, 4, 6, 7]
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.redact_personal_data(spark, frame, SF).collect()}
    assert masked[6][0] == "write to [EMAIL] about the garden behind the house" and masked[6][1] == len(masked[6][0]) and masked[1] == (text, len(text))
    packed = corpus_pipeline.pack_sequences(spark, frame, SF).collect()
    assert sorted(r["doc_id"] for r in packed) == [1, 2, 3, 4, 5, 6, 7] and len({r["sequence_id"] for r in packed}) == 1
