"""The pipeline against brute force where there is one, stage by stage."""

from test_operators import brute_components

import corpus_pipeline
from blockwright.llm import toxicity


def test_stages(spark, sf, documents):
    columns = documents.columns
    docs, text = documents, {r["doc_id"]: r["text"] for r in documents.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf).collect()
    rejected = {r["doc_id"] for r in toxicity.predict(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept} == set(text) - rejected
    want = brute_components(list(text.items()))
    unique = stages["near_duplicates"](spark, docs, sf)
    assert {r["doc_id"] for r in unique.collect()} == {i for i in text if want[i][2] == i}
    assert unique.columns == columns
    shorter = stages["repeated_passages"](spark, docs, sf)
    assert shorter.columns == columns and {r["doc_id"] for r in shorter.collect()} == set(text)
    assert all(r["n_chars"] == len(r["text"]) for r in shorter.collect())
    clean = stages["decontamination"](spark, docs, sf)
    assert clean.columns == columns and 0 < clean.count() < len(text)


def test_run(spark, sf, documents):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(rows) < documents.count() and all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)


def test_edges(spark, sf, edge, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select("doc_id", "text", "lang", "source", "n_chars"), sf).count() == 0
        assert stage(spark, edge, sf).count() > 0
