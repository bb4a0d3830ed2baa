"""The pipeline's stages against plain readings of what the stage before kept."""

import corpus_pipeline
from conftest import SF
from test_text_operators import brute_components

from tessera.llm.shared import written


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        gone = before.keys() - rows.keys()
        if name == "quality classifier":
            assert gone and not [i for i in gone if labels.get(i) == 1]
        if name == "n-gram Jaccard join":
            kept = {i for i, n, c in brute_components(sorted(before.items()), 5, 80) if i == c}
            assert rows.keys() == kept
        if name == "benchmark decontamination":
            bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            whole = {i for i, t in before.items() if any(b in " ".join(t.lower().split()) for b in bench)}
            assert whole <= gone and len(gone) <= len(whole) + 5
        if name == "secret scans":
            assert not gone and all(r.n_chars == len(r.text) for r in rows.values())
            assert not [1 for r in rows.values() if 'token = "' in r.text.lower() and "<secret>" not in r.text]
        before = {i: r.text for i, r in rows.items()}
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == before.keys()
