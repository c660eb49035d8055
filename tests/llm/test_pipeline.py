"""Each stage of the pipeline against what its operator says, and the whole of it."""

import re
from collections import Counter

import corpus_pipeline
from ebbtide.llm import pii
from tests.llm.fixtures import empty_docs
from tests.llm.test_jaccard import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "source_mixing", "sentencepiece"]
    seen = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, seen[-1], d).write.parquet(out)
        seen.append(spark.read.parquet(out))
        if i < 4:
            assert seen[-1].columns == COLUMNS
    start, calm, single, clean, mixed, ids = ([r for r in df.collect()] for df in seen)
    assert {r.doc_id for r in calm} <= {r.doc_id for r in start} and len(calm) > 0.85 * len(start)
    groups = plain([(r.doc_id, r.text) for r in calm], 5, 80)
    assert sorted(r.doc_id for r in single) == sorted({c for *_, c in groups})
    before = {r.doc_id: r.text for r in single}
    for r in clean:
        assert pii.base_spans(r.text) == [] or "[" in r.text
        assert bool(pii.base_spans(before[r.doc_id])) <= (r.text != before[r.doc_id])
    n = Counter(r.doc_id for r in mixed)
    assert set(n) <= set(before) and max(n.values()) <= 3
    assert sorted(r.doc_id for r in ids) == sorted(r.doc_id for r in mixed) and all(r.n_tokens >= 2 for r in ids)
    assert all(re.fullmatch("[0-9a-f]{64}", r.ids_sha256) for r in ids)


def test_empty_documents(spark, tmp_path):
    docs = empty_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(out)
        assert spark.read.parquet(out).count() == 0
