import corpus_pipeline
from tapeline.llm import minhash, perplexity


def test_stages_hand_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "bpe_encoding"]
    kept = {r["doc_id"] for r in perplexity.query(spark, sf_dir).filter("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = corpus_pipeline.quality(spark, docs, sf_dir)
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == kept

    second = corpus_pipeline.line_dedup(spark, first, sf_dir)
    rows = second.collect()
    assert second.columns == columns and {r["doc_id"] for r in rows} == kept
    for r in rows:
        assert set(r["text"].split("\n")) <= set(texts[r["doc_id"]].split("\n")) | {""} and r["n_chars"] == len(r["text"])

    third = corpus_pipeline.near_dedup(spark, second, sf_dir)
    want = {r["doc_id"] for r in minhash.join(second).filter("kept").collect()}
    assert third.columns == columns and {r["doc_id"] for r in third.collect()} == want

    fourth = corpus_pipeline.mix(spark, third, sf_dir)
    assert fourth.columns == columns and {r["doc_id"] for r in fourth.collect()} <= want

    last = corpus_pipeline.encode(spark, fourth, sf_dir)
    assert last.count() == fourth.count() and {"doc_id", "n_tokens", "ids"} <= set(last.columns)
